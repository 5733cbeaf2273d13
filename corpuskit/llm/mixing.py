"""Mixing sources to target weights, with exact budgets of words.

Each document gets a hash-random key. Within a source, documents in key order form one pass
(epoch); the source's budget of words cuts that order, passes repeating where the budget is larger
than the source. The order is never made by one task: as keys are uniform, equal ranges of the key
space are even pieces of a source. About the square root of a source's documents make a piece, so
that neither a piece nor the list of a source's pieces grows large; running sums inside the pieces
and over the pieces give each document's place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit.llm._shared import WORD, written

#: Weights of the sources in code-point order, repeating; the share of all words to take; most passes.
WEIGHTS, SHARE, PASSES = (5.0, 2.0, 1.0), 1.5, 2.0


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, passes: float = PASSES) -> list[tuple[str | None, float]]:
    """The words to take of each source. What a source cannot give is shared among the rest by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, found = dict(order), {}
    left = share * sum(size.values())
    while len(found) < len(order):
        free = [s for s in size if s not in found]
        unit = left / sum(weight[s] for s in free)
        above = [s for s in free if unit * weight[s] > passes * size[s]]
        for s in above or free:
            found[s] = passes * size[s] if above else unit * weight[s]
        left -= sum(passes * size[s] for s in above)
    return [(s, float(found[s])) for s, _ in order]


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "", weights=WEIGHTS, share: float = SHARE, passes: float = PASSES) -> DataFrame:
    """key, size, source, source_size, target, taken for each row of df.

    size: words of the text (null: 0). taken: words that the mix takes of the row, repeats
    counted; a source's rows together take the floor of its target exactly, so one row of a source
    may be taken in part. Null sources are one source, the last. A null key sorts as the text
    "null"; equal rows share a key and take places beside each other. No rows: none. Other columns
    do not pass. Per-source totals go through the driver: one row for each source, as the weights
    do; everything else is dealt out by (source, piece).
    """
    name = F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    meta = df.select(
        F.col(key).alias("key"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        # 60 random bits
        F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint").alias("rnd"),
    )
    meta = written(meta, "mix")
    spark = df.sparkSession
    sums = [tuple(r) for r in meta.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()]
    target = dict(targets([(s, n) for s, n, _ in sums], weights, share, passes))
    plan = spark.createDataFrame([(s, n, target[s], math.isqrt(rows) + 1) for s, n, rows in sums], "s string, source_size bigint, target double, pieces bigint")
    rows = meta.join(plan, meta["source"].cast("string").eqNullSafe(plan["s"])).drop("s")
    rows = rows.withColumn("piece", F.floor(F.col("rnd") / F.lit(float(1 << 60)) * F.col("pieces")))
    inside = Window.partitionBy("source", "piece").orderBy("rnd", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy("source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("source", "piece").agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(over), F.lit(0)))
    pieces = pieces.select(F.col("source").alias("s"), F.col("piece").alias("p"), "before")
    placed = rows.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(pieces, placed["source"].eqNullSafe(pieces["s"]) & (placed["piece"] == pieces["p"]))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col("before") - F.col("start")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))
    return placed.select("key", "size", "source", "source_size", "target", taken.cast("bigint").alias("taken"))


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "") -> DataFrame:
    """The rows of df that the mix takes, once for each pass; columns as in df.

    A row that its source's budget cuts counts as taken when at least half of its words are, so
    that texts stay whole and each source comes within a document of its target.
    """
    taken = mix(df, key, source, text, seed)
    # equal keys: the same number of copies of each, at most two passes of either
    copies = taken.groupBy("key").agg(F.max(F.when(F.col("size") > 0, F.floor((F.col("taken") * 2 + F.col("size")) / (2 * F.col("size")))).otherwise(0)).alias("__copies"))
    copies = copies.withColumnRenamed("key", "__key").filter("__copies > 0")
    both = df.join(copies, df[key].eqNullSafe(copies["__key"]))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*(df[c] for c in df.columns))
