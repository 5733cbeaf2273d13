"""Jaccard similarity join of word n-gram sets by prefix filters under several token orders.

A set of n shingles links with another when 100 * |both| >= percent * |either|, so it can miss at
most m(n) = n - ceil(percent * n / 100) of its shingles in a partner, and sizes differ little. Under
any order of all shingles that both sets follow, partners therefore share one of their first m + 1.
The join uses four orders, and a pair is compared in full only when it passes all of them:

1.  By hash, up to a common bound. Only the shingles below a bound on the hash (a fixed share of all,
    larger for small sets) are counted over the corpus. A set with more than m shingles there that no
    other set has cannot link; that settles nearly all documents at a fraction of the shuffle.
2.  By frequency, rarest first, over the whole sets of those that are left. Candidates must share a
    shingle of both prefixes, at places that leave enough shingles behind them.
3., 4. By two further hashes: the prefixes under each must meet too.

Documents with equal sets are one class. Groups of near copies aren't expanded into all pairs: first
each prefix shingle's sets are compared with the one among them that has the fewest rare shingles;
after joining what links, only pairs across different components are left to compare. What is
returned are components, and any pair of them that could link has been compared or is connected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit.llm._shared import dropped, in_arrow, written
from corpuskit.llm.components import components
from corpuskit.llm.words import listed, slices, split

#: Up to so many sets that pass the first filter are sent to the scan as a broadcast list of ids (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A shingle that more than so many sets hold in their prefixes is parted further before its pairs are made.
HOT = 2000

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def scrambled(x: np.ndarray, key: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers, another one for each key."""
    x = (x ^ np.uint64(key * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * ODD[0]
    x ^= x >> np.uint64(32)
    x = x * ODD[4]
    return x ^ (x >> np.uint64(29))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-grams of words, which are given by their hashes."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    span = min(n, width)
    out = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        out = scrambled(out ^ (words[k : n - span + 1 + k] * ODD[k % 5] + np.uint64(k)))
    return np.unique(out)


def may_miss(n, percent: int):
    return n - (percent * n + 99) // 100


def room_to_miss(percent: int) -> "F.Column":
    n = F.col("n")
    return n - F.expr(f"(n * {percent} + 99) div 100")


def share(n: int, width: int, percent: int) -> float:
    """The share of the hash range in which a set of n is tested: it falls with n. It has to hold more
    than m(n) shingles that few sets have, and fewer of the short ones are rare; any share is right."""
    return min(1.0, (1.7 if width < 4 else 1.3) * (1 - percent / 100) + 12 / n) if n else 1.0


def below(hashes: np.ndarray, part: float) -> int:
    return len(hashes) if part >= 1 else int(np.searchsorted(hashes, np.uint64(int(part * 2.0**64))))


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(kind.to_pandas_dtype()), kind))


def sets_of(df: DataFrame, width: int, percent: int, whole: bool) -> DataFrame:
    """id, n, class of each (id, text); and either the hashes that the first order counts, of which
    the first `tested` are the set's own test, or the whole set with its prefixes in orders 3 and 4."""
    schema = "id bigint, n bigint, class binary" + (", hashes array<bigint>, third array<int>, fourth array<int>" if whole else ", short bigint, tested bigint, hashes array<bigint>")
    names = [x.split()[0] for x in schema.split(", ")]

    def made(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = [len(s) for s in sets]
        kinds = [hashlib.md5(s.tobytes()).digest() for s in sets]
        out = [ids, pa.array(n, pa.int64()), pa.array(kinds, pa.binary())]
        if whole:
            first = [may_miss(k, percent) + 1 for k in n]
            orders = [[np.sort(scrambled(s, key))[:f].astype(np.uint32).view(np.int32) for s, f in zip(sets, first, strict=True)] for key in (3, 4)]
            out += [_lists(list(map(signed, sets)), pa.int64()), *(_lists(o, pa.int32()) for o in orders)]
        else:
            out.append(pa.array([int.from_bytes(c[:8]) >> 4 for c in kinds], pa.int64()))
            out.append(pa.array([below(s, share(k, width, percent)) for s, k in zip(sets, n, strict=True)], pa.int64()))
            # a partner may be smaller, and then its test reaches farther
            out.append(_lists([signed(s[: below(s, share(percent * k // 100, width, percent))]) for s, k in zip(sets, n, strict=True)], pa.int64()))
        return pa.RecordBatch.from_arrays(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, rows in slices(batch.column("raw")):
                piece = batch.slice(low, rows)
                starts, codes, words = split(piece.column("raw"), lower=True)
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, listed(words)), np.uint64, len(words))[codes]
                yield made(piece.column("id"), [shingles(hashes[a:b], width) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])

    return in_arrow(df, run, schema)


def _few(rows: DataFrame) -> DataFrame:
    """rows for a join: sent to every task, or shuffled when there are more than BROADCAST_IDS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, held: list[str]) -> DataFrame:
    """Of pairs of rows of sets (x, y), those that link, as a, b of their ids. Only the sets of pairs that pass the orders 3 and 4 are shuffled whole."""
    light = lambda s: sets.select(*(F.col(c).alias(f"{c}_{s}") for c in ("row", "id", "n", "third", "fourth")))
    met = pairs.join(light("x"), F.col("x") == F.col("row_x")).join(light("y"), F.col("y") == F.col("row_y"))
    met = met.filter(F.arrays_overlap("third_x", "third_y") & F.arrays_overlap("fourth_x", "fourth_y")).select("x", "y", "id_x", "id_y", "n_x", "n_y")
    met = written(met, "met", held)
    asked = written(met.select(F.explode(F.array("x", "y")).alias("r")).distinct(), "asked", held)
    whole = sets.select("row", "hashes").join(_few(asked), F.col("row") == F.col("r"), "left_semi")
    heavy = lambda s: whole.select(F.col("row").alias(f"r_{s}"), F.col("hashes").alias(f"hashes_{s}"))
    met = met.join(heavy("y"), F.col("y") == F.col("r_y")).join(heavy("x"), F.col("x") == F.col("r_x"))
    both = F.size(F.array_intersect("hashes_x", "hashes_y")).cast("bigint")
    return met.filter(both * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent).select(F.col("id_x").alias("a"), F.col("id_y").alias("b"))


def _pairs(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of rows of sets in different parts that share a prefix shingle, at places and of sizes that leave a link possible.

    placed: row, n, at, h, part. Sizes of linked sets differ little, so a shingle's sets are parted by
    size as well, and each meets those of its own step of sizes and of the next. Where more than HOT sets
    hold a shingle they are parted by the tokens of their third prefix too, which any linked pair shares,
    so that no task enumerates all pairs of a hot shingle.
    """
    step = F.floor(F.log("n") / F.lit(math.log(100 / percent) + 1e-9))  # a partner's is the same or the next
    placed = placed.withColumn("step", step)
    counts = placed.groupBy("h").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("sets")).filter("low < high")
    placed = placed.join(counts.select("h", (F.col("sets") > HOT).alias("hot")), "h")
    third = sets.select(F.col("row").alias("r"), "third")
    hot = placed.filter("hot").join(third, F.col("row") == F.col("r")).withColumn("t", F.explode("third"))
    keyed = placed.filter("NOT hot").withColumn("t", F.lit(0)).select("row", "n", "at", "h", "t", "step", "part").unionByName(hot.select("row", "n", "at", "h", "t", "step", "part"))
    x = keyed.withColumn("meets", F.explode(F.array(F.col("step"), F.col("step") + 1)))
    side = lambda d, s: d.select(*(F.col(c).alias(f"{c}_{s}") for c in d.columns))
    met = (F.col("h_x") == F.col("h_y")) & (F.col("t_x") == F.col("t_y")) & (F.col("meets_x") == F.col("step_y")) & (F.col("part_x") != F.col("part_y")) & enough("x", "y", percent)
    # of one step, each pair once; the smaller row first in the end
    met = met & ((F.col("step_x") != F.col("step_y")) | (F.col("row_x") < F.col("row_y")))
    return side(x, "x").join(side(keyed, "y"), met).select(F.least("row_x", "row_y").alias("x"), F.greatest("row_x", "row_y").alias("y")).distinct()


def enough(a: str, b: str, percent: int) -> "F.Column":
    """A link between two sets leaves at least this many shingles from the shared place on."""
    return F.least(F.col(f"n_{a}") - F.col(f"at_{a}"), F.col(f"n_{b}") - F.col(f"at_{b}")) * (100 + percent) >= (F.col(f"n_{a}") + F.col(f"n_{b}")) * percent


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """key, n_shingles, component_id for each row of df.

    Words are runs of other than ASCII white space, A-Z lower-cased; a text of fewer than `width`
    words is one shingle, its whole sequence; a null text or one without words has none and links
    with nothing. Shingles are told apart by 64-bit hashes. component_id is the smallest key that
    links reach, the row's own included. Rows that repeat a key are one node of the links, whichever
    row has them; rows with a null key link with nothing and have a null component. No rows: none.
    Texts are read whole, a few megabytes or one longer text at a time. Other columns do not pass, so
    their names cannot clash.
    """
    spark, held = df.sparkSession, []
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("binary").alias("raw"))
    first = written(sets_of(docs, width, percent, whole=False), "shingles")
    some = first.filter("n > 0 AND id IS NOT NULL")
    classes = written(some.groupBy("n", "class", "short").agg(F.min("id").alias("id")), "classes")
    # keys whose rows have different sets tie their classes together
    mixed = some.groupBy("id").agg(F.min("short").alias("low"), F.max("short").alias("high")).filter("low < high").select(F.col("id").alias("k"))
    tied = some.select("id", "class").join(mixed, F.col("id") == F.col("k"), "left_semi").distinct()
    tied = tied.join(classes.select(F.col("class").alias("c"), F.col("id").alias("a")), F.col("class") == F.col("c")).select("a", F.col("id").alias("b"))
    tied = written(tied, "tied", held)

    # order 1: hashes below the bounds that only one class has, and how many of them it has. Copies
    # have one class and so count once. 60 bits of a class name it here; where two classes share them,
    # both stay.
    hashed = some.select("short", F.posexplode("hashes").alias("at", "h"), "tested").select("short", "h", (F.col("at") < F.col("tested")).alias("test"))
    alone = hashed.groupBy("h").agg(F.min("short").alias("short"), F.max("short").alias("other"), F.min("test").alias("test")).filter("short = other AND test")
    alone = alone.groupBy("short").agg(F.count(F.lit(1)).alias("alone"))
    twins = classes.groupBy("short").agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    left = classes.join(alone, "short", "left").join(twins, "short", "left")
    left = left.filter((F.coalesce("alone", F.lit(0)) <= room_to_miss(percent)) | F.col("classes").isNotNull())
    left = written(left.select("id", "class"), "left", held)
    ids = _few(left.select("id").distinct())
    sets = sets_of(docs.join(ids, "id", "left_semi"), width, percent, whole=True).filter("n > 0")
    # from here on a set is known by its row here, 8 bytes
    sets = written(sets.withColumn("row", F.monotonically_increasing_id()), "sets", held)
    # a class's set stays under the key that names it, and once: only rows that repeat a key can go
    named = left.select(F.col("id").alias("i"), F.col("class").alias("c"))
    kept = sets.select("id", "class", "row").join(named, (F.col("id") == F.col("i")) & (F.col("class") == F.col("c")), "left_semi").groupBy("class").agg(F.min("row").alias("r"))
    again = written(sets.select("row").join(kept, F.col("row") == F.col("r"), "left_anti").select(F.col("row").alias("r")), "again", held)
    if not again.isEmpty():
        sets = written(sets.join(_few(again), F.col("row") == F.col("r"), "left_anti"), "sets", held)

    # order 2: rarest first among the sets that are left. Shingles are shuffled once to be counted,
    # and those of two sets or more once again to be ranked, each time only with the row of their set.
    tokens = sets.select("row", F.explode("hashes").alias("h"))
    common = tokens.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("sets > 1")
    common = common.withColumn("k", F.row_number().over(Window.partitionBy("row").orderBy("sets", "h")) - 1).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("row")))
    common = common.join(sets.select(F.col("row").alias("r"), "id", "n"), F.col("row") == F.col("r")).withColumn("rare", F.col("n") - F.col("shared"))
    prefix = common.filter(F.col("k") <= room_to_miss(percent) - F.col("rare"))
    prefix = written(prefix.select("row", "id", "n", "rare", (F.col("rare") + F.col("k")).alias("at"), "h"), "prefix", held)

    side = lambda d, s: d.select(*(F.col(c).alias(f"{c}_{s}") for c in d.columns))
    centres = prefix.groupBy("h").agg(F.min(F.struct("rare", "id", "row", "n", "at")).alias("c"), F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("h", "c.*")
    stars = side(prefix, "y").join(side(centres, "x"), F.col("h_x") == F.col("h_y")).filter((F.col("row_x") != F.col("row_y")) & enough("x", "y", percent))
    links = _compared(stars.select(F.col("row_x").alias("x"), F.col("row_y").alias("y")).distinct(), sets, percent, held)
    links = written(links.unionByName(tied), "links", held)

    # what is left: pairs across components
    joined = components(links)
    placed = prefix.join(joined, F.col("id") == F.col("node"), "left").select("row", "n", "at", "h", F.coalesce("component", "id").alias("part"))
    more = written(_compared(_pairs(placed, sets, percent), sets, percent, held), "links", held)
    joined = components(links.unionByName(more)) if not more.isEmpty() else joined
    dropped(spark, held)

    ends = classes.join(joined, F.col("id") == F.col("node"), "left").select(F.col("class").alias("c"), F.coalesce("component", "id").alias("component"))
    out = first.select("id", "n", "class").join(ends, F.col("class") == F.col("c"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id")).alias("component_id"))


def first_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df whose key is the smallest of its component, and those with a null key; rows that repeat a key stay or go together. Up to BROADCAST_IDS keys that go are sent to the scan, beyond it both sides shuffle."""
    found = near_duplicates(df, key, text, width, percent)
    gone = written(found.filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("__key")).distinct(), "gone")
    gone = _few(gone)
    return df.join(gone, df[key] == gone["__key"], "left_anti").select(*df.columns)
