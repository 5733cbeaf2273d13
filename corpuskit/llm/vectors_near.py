"""Near-duplicate embeddings: quantised tile products with error bounds, then exact cosines.

Vectors of a label are dealt into blocks, and every pair of blocks is a tile. A vector v of length
one is written as s*q + e with q of 8-bit integers; the length of e is known exactly. Then
v.w = (s*q).(s'*q') + v.e' + e.(s'*q'), so by Cauchy-Schwarz the product of the integers is off by
at most |e'| + |e| * |s'*q'|. Only pairs that this bound leaves possibly at or above the threshold
are computed in double precision. (Products of 8-bit integers are taken in float32 tiles, exact
while dimension * 127 * 127 is below 2^24, where one call does a whole tile.)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._shared import written
from corpuskit.llm.components import components

#: About so many vectors make a block; tiles are dealt to at most so many tasks.
BLOCK, MOST_TASKS = 2048, 20_000


def usable(vector: str) -> "F.Column":
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit rows (as float32), their scales, lengths of the scaled rows, lengths of what is lost; lengths rounded up."""
    scale = np.abs(unit).max(1) / 127
    whole = np.rint(unit / scale[:, None])
    kept = whole * scale[:, None]
    up = 1 + 1e-9
    return whole.astype(np.float32), scale, np.linalg.norm(kept, axis=1) * up, np.linalg.norm(unit - kept, axis=1) * up + 1e-12


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and rows of y whose cosine is at least the threshold, some rows of x at a time."""
    # each row by its largest component first, so that no square overflows or vanishes
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, kx, ex), (qy, sy, ky, ey) = quantise(x / norm_x[:, None]), quantise(y / norm_y[:, None])
    exact = x.shape[1] * 127 * 127 < 1 << 24
    for low in range(0, len(x), 256):
        rows = slice(low, low + 256)
        product = (qx[rows] @ qy.T if exact else qx[rows].astype(float) @ qy.T.astype(float)) * sx[rows, None] * sy[None]
        i, j = np.nonzero(product + ey[None] + ex[rows, None] * ky[None] >= threshold - 1e-9)
        i += low
        for part in range(0, len(i), 1 << 16):  # full precision
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            found = np.einsum("ij,ij->i", x[a], y[b]) / (norm_x[a] * norm_y[b]) >= threshold
            yield a[found], b[found]


def roots(n: int, i: np.ndarray, j: np.ndarray, up: list[int]) -> None:
    """Union of i and j in up, smaller index first."""

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    # most pairs of a dense group repeat what is known: only one pair for each pair of roots is walked
    while len(i):
        heads = np.array([top(k) for k in range(n)])
        a, b = heads[i], heads[j]
        differ = a != b
        if not differ.any():
            return
        i, j = i[differ], j[differ]
        pairs = np.unique(np.stack([np.minimum(a, b)[differ], np.maximum(a, b)[differ]], 1), axis=0)
        for p, q in pairs.tolist():
            p, q = top(p), top(q)
            up[max(p, q)] = min(p, q)


def numbered(df: DataFrame, *columns, name: str) -> DataFrame:
    """The columns with a number of each row's own, written: rows that repeat a key stay apart, and numbers stay the same."""
    return written(df.select(F.monotonically_increasing_id().alias("row"), *columns), name)


def near_vectors(df: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """key, n_links, component_id, kept: one row for each row of df.

    Two vectors link when their labels are equal and not null, their lengths are equal and their
    cosine is at least the threshold. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing, as do null labels. Rows that repeat a key are vectors of
    their own, which may link with each other; rows with a null key are left out of linking and
    returned with no links, component null and kept false. No rows: none. A tile returns counts and one link to
    its smallest member for each vector, never its pairs; a label of any size becomes more tiles.
    """
    rows = numbered(df, F.col(key).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"), name="vectors")
    good = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    counts = good.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    good = good.join(counts, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    tiles = good.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    tiles = tiles.select("row", "v", "label", "dim", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def tile(t: pa.Table) -> pa.Table:
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        ids, own = t.column("row").to_numpy(), t.column("own").to_numpy()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, own, v = ids[order], own[order], v[order]
        a, b = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        links, up = np.zeros(len(ids), np.int64), list(range(len(ids)))
        if len(a) and len(b):
            for x, y in linked(v[a], v[b], threshold):
                x, y = a[x], b[y]
                if i == j:
                    x, y = x[x < y], y[x < y]
                links += np.bincount(x, minlength=len(ids)) + np.bincount(y, minlength=len(ids))
                roots(len(ids), x, y, up)
        top = np.arange(len(ids))
        for k in range(len(ids)):
            top[k] = top[up[k]]
        some = links > 0
        return pa.table({"row": ids[some], "links": links[some], "root": ids[top[some]]})

    # the work is in the products, not in the bytes, so the number of tasks follows the tiles
    n = counts.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 1
    tiles = tiles.repartition(int(min(max(n, 1), MOST_TASKS)), "label", "dim", "i", "j")
    found = written(tiles.groupBy("label", "dim", "i", "j").applyInArrow(tile, "row bigint, links bigint, root bigint"), "tiles")
    total = found.groupBy("row").agg(F.sum("links").alias("n"))
    together = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    linked_rows = rows.select("row", "id").join(together, F.col("row") == F.col("node"))
    least = linked_rows.groupBy(F.col("component").alias("c")).agg(F.min("id").alias("least"))
    named = together.join(least, F.col("component") == F.col("c")).select("node", "least")
    out = rows.select("row", "id").join(total, "row", "left").join(named, F.col("row") == F.col("node"), "left")
    out = out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
