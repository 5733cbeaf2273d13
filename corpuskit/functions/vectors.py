"""Vector arithmetic in double precision on arrays, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null when either has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, 1 - dot(a, b) / lengths)


def l2_normalize(a: Column) -> Column:
    return F.transform(a, lambda x: (x.cast("double") / F.greatest(norm(a), F.lit(1e-12))).cast("float"))


def mean_pool(tokens: DataFrame, key: str = "text_id", mask: str = "mask", vector: str = "vec") -> DataFrame:
    """Masked mean of each text's token vectors: sum(v * m) / max(sum(m), 1e-9) in every dimension."""
    long = tokens.select(key, F.col(mask).cast("double").alias("__m"), F.posexplode(vector).alias("__dim", "__v"))
    pooled = long.groupBy(key, "__dim").agg((F.sum(F.col("__v").cast("double") * F.col("__m")) / F.greatest(F.sum("__m"), F.lit(1e-9))).alias("__x"))
    parts = pooled.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__dim", "__x"))).alias("__parts"))
    return parts.select(key, F.transform("__parts", lambda p: p["__x"]).cast("array<float>").alias("embedding"))
