"""Exact top-k by integer inner product: Fagin's threshold algorithm over sorted lists.

Candidates are dealt into blocks and queries into chunks; a task has one of each. It sorts the
block once by every dimension. For a query, each dimension's list is read from its better end (the
top for a positive query component, the bottom for a negative one), a stretch of all lists at a
time; vectors seen for the first time are scored in full; and the reading stops once no unseen
vector, which is at best the sum over the dimensions of the query component times the value last
read there, can reach the k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit.llm._shared import written
from corpuskit.llm.vectors_near import numbered, usable

BLOCK, QUERIES = 4096, 256
#: Rows of the first stretch of all lists; each stretch is twice the one before. Tiles are dealt to at most so many tasks.
FIRST, MOST_TASKS = 4, 20_000


class Lists:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, numbers: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        #: What names a row, where ids may repeat.
        self.numbers = self.ids if numbers is None else numbers[order]
        self.scored = 0
        self.order = np.argsort(-self.rows, axis=0, kind="stable")  # a list for each dimension, best first
        self.value = np.take_along_axis(self.rows, self.order, 0)
        # sums of products stay exact in double below 2^53
        self.fast = self.rows.astype(float) if np.abs(self.rows).max(initial=0) < 1 << 22 else None

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, equal scores by smaller id; the query's own row takes no part."""
        n = len(self.ids)
        seen = self.numbers == own
        best_at, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        down = query < 0
        dims = np.nonzero(query)[0]
        depth, stretch = 0, FIRST
        while not seen.all():
            end = min(n, depth + stretch)
            up_part = self.order[depth:end][:, dims[~down[dims]]]
            low_part = self.order[n - end : n - depth][:, dims[down[dims]]]
            fresh = np.zeros(n, bool)
            fresh[up_part.ravel()] = fresh[low_part.ravel()] = True
            if not len(dims):
                fresh[:] = True
            fresh = np.nonzero(fresh & ~seen)[0]
            seen[fresh] = True
            self.scored += len(fresh)
            if self.fast is not None and np.abs(query).max(initial=0) < 1 << 22:
                scores = (self.fast[fresh] @ query.astype(float)).astype(np.int64)
            else:
                scores = self.rows[fresh] @ query
            best_at, best = np.concatenate([best_at, fresh]), np.concatenate([best, scores])
            if len(best) > k:
                top = np.lexsort((best_at, -best))[:k]  # positions are in id order
                best_at, best = best_at[top], best[top]
            if end == n:
                break
            bound = int(query[dims] @ np.where(down[dims], self.value[n - end, dims], self.value[end - 1, dims]))
            if len(best) == k and bound < best.min():
                break
            depth, stretch = end, stretch * 2
        top = np.lexsort((best_at, -best))[:k]
        return self.ids[best_at[top]], best[top]


def top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, chunk: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    Components become floor(scale * x). Queries are the rows whose key is divisible by `every`;
    candidates all rows of the same dimension but the query's own. Vectors that are null, empty or
    hold a null or non-finite component take no part, nor do null keys; rows that repeat a key count
    as one, the one with the greatest vector. Fewer than k candidates: all. No rows: none. A tile
    returns at most k rows for each of its queries.
    """
    good = df.filter(F.col(key).isNotNull() & usable(vector))
    floors = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    rows = numbered(good, F.col(key).cast("bigint").alias("id"), floors.alias("v"), F.size(vector).alias("dim"), name="integers")
    asked = F.pmod("id", F.lit(every)) == 0
    counts = written(rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if(asked) / chunk)).cast("int").alias("chunks")), "counts")
    dealt = rows.join(counts, "dim").withColumn("h", F.xxhash64("row"))
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    candidates = dealt.select("row", "id", "v", "dim", F.lit(False).alias("query"), F.pmod("h", "blocks").cast("int").alias("b"), whole("chunks").alias("c"))
    queries = dealt.filter(asked).select("row", "id", "v", "dim", F.lit(True).alias("query"), whole("blocks").alias("b"), F.pmod("h", "chunks").cast("int").alias("c"))

    def tile(t: pa.Table) -> pa.Table:
        row, ids, query = (t.column(c).to_numpy() for c in ("row", "id", "query"))
        v = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        lists = Lists(ids[~query], v[~query], row[~query])
        out = [(i, *lists.search(row[i], v[i], k)) for i in np.nonzero(query)[0].tolist()]
        at = np.repeat(np.array([x[0] for x in out], np.int64), [len(x[1]) for x in out])
        some = lambda k: np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64)
        return pa.table({"query": row[at], "query_id": ids[at], "vec_id": some(1), "score": some(2)})

    # the work is in the tiles, not in the bytes, so the number of tasks follows the tiles
    n = counts.agg(F.sum(F.col("blocks") * F.col("chunks"))).first()[0] or 1
    tiles = candidates.unionByName(queries).repartition(int(min(n, MOST_TASKS)), "dim", "b", "c")
    found = tiles.groupBy("dim", "b", "c").applyInArrow(tile, "query bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
