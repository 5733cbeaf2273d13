"""Helpers that the training-data operators share: the shared folder, written tables, table paths."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a local session without that setting gets a folder of its own (tests); a cluster
    without it is an error, as executors could not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='corpuskit-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/corpuskit/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended; the cluster's own cleaning takes the rest
        pass


def written(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage and outlives lost executors. Its path goes to `held`, for dropped()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if held is not None:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, held: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in held:
        delete(spark, path)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Batches that go to Python hold about `most` bytes, or one longer row, instead of Spark's 64 MB; a session that sets its own keeps it."""
    if spark.conf.get(BATCH, "67108864b") == "67108864b":
        spark.conf.set(BATCH, str(most))


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the machine: workers stay for later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with bounded batches, and workers that give their memory back at a task's end."""
    bounded_batches(df.sparkSession)

    def task(batches):
        yield from run(batches)
        tidy()

    return df.mapInArrow(task, schema)


def split_of(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the fold of a row. A null key has fold 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus, F.lit(0).cast("bigint"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return os.environ.get("CORPUSKIT_TOKENIZERS", "") and os.path.join(os.environ["CORPUSKIT_TOKENIZERS"], name) or public_tokenizers.path(name)
