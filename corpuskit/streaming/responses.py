"""Streamed responses: chunks of four dialects, folded into texts, metadata and statistics.

A dialect is a schema with expressions for a chunk's text, whether it ends the stream, and its
metadata. fold() uses aggregations only, so it runs the same on a table and on readStream.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuskit import schemas
from corpuskit.functions.scalars import megabytes, percentage, round2, seconds


@dataclass(frozen=True)
class Dialect:
    schema: str
    text: Column
    done: Column
    metadata: Column


def _c(path: str) -> Column:
    return F.col(f"chunk.{path}")


def dialect(name: str) -> Dialect:
    """generate (a local model's text or chat), choices, events or download."""
    if name == "generate":
        # a message decides, also one without content
        text = F.when(_c("message").isNotNull(), F.coalesce(_c("message.content"), F.lit(""))).otherwise(F.coalesce(_c("response"), F.lit("")))
        fields = ("total_duration", "load_duration", "prompt_eval_count", "prompt_eval_duration", "eval_count", "eval_duration", "context", "done_reason", "model", "created_at")
        return Dialect(schemas.GENERATE_CHUNK, text, F.coalesce(_c("done"), F.lit(False)), F.struct(*(_c(f).alias(f) for f in fields)))
    if name == "choices":
        first = F.get(_c("choices"), F.lit(0))
        return Dialect(schemas.CHOICES_CHUNK, F.coalesce(first["delta"]["content"], F.lit("")), F.coalesce(first["finish_reason"].isNotNull(), F.lit(False)), F.struct(first["finish_reason"].alias("finish_reason"), _c("model").alias("model"), _c("usage").alias("usage")))
    if name == "events":
        return Dialect(schemas.EVENTS_CHUNK, F.when(_c("type") == "content_block_delta", F.coalesce(_c("delta.text"), F.lit(""))).otherwise(""), F.coalesce(_c("type") == "message_stop", F.lit(False)), F.struct(_c("usage").alias("usage"), _c("model").alias("model"), _c("stop_reason").alias("stop_reason")))
    if name == "download":
        return Dialect(schemas.DOWNLOAD_CHUNK, F.coalesce(_c("status"), F.lit("")), F.coalesce(_c("status") == "success", F.lit(False)), F.struct(_c("status").alias("status"), _c("digest").alias("digest"), _c("total").alias("total"), _c("completed").alias("completed")))
    raise ValueError(f"unknown dialect {name!r}; known: choices, download, events, generate")


def parsed(lines: DataFrame, name: str) -> DataFrame:
    """stream_id, seq, chunk of the non-empty lines (stream_id, seq, value)."""
    return lines.filter(F.length("value") > 0).select("stream_id", "seq", F.from_json("value", dialect(name).schema).alias("chunk"))


def until_done(rows: DataFrame, done: Column, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """Rows of each stream up to and with its first that ends it."""
    end = F.min(F.when(done, F.col(seq))).over(Window.partitionBy(stream))
    return rows.withColumn("__end", end).filter(F.col("__end").isNull() | (F.col(seq) <= F.col("__end"))).drop("__end")


def ordered_text(text: Column, seq: str = "seq") -> Column:
    """Aggregate: texts joined in order of seq; allowed in streaming aggregations."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), text.alias("t")))), lambda x: x["t"]), "")


def fold(chunks: DataFrame, name: str) -> DataFrame:
    """stream_id, text, chunks (how many), done and metadata (of the last chunk that ends the stream)."""
    d = dialect(name)
    return chunks.groupBy("stream_id").agg(ordered_text(d.text).alias("text"), F.count(F.lit(1)).alias("chunks"), F.max(d.done).alias("done"), F.max_by(F.when(d.done, d.metadata), F.when(d.done, F.col("seq"))).alias("metadata"))


def running_text(rows: DataFrame, text: str, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """rows with full_text, what has been said so far."""
    w = Window.partitionBy(stream).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("full_text", F.array_join(F.collect_list(text).over(w), ""))


def generate_stats(folded: DataFrame) -> DataFrame:
    """Seconds and tokens per second of a local model's final metadata; no speed without evaluation time."""
    m = lambda f: F.col(f"metadata.{f}")
    spent = seconds(m("eval_duration"))
    return folded.select("stream_id", round2(seconds(m("total_duration"))).alias("total_s"), round2(spent).alias("eval_s"), m("eval_count").alias("tokens"), round2(F.when(spent > 0, m("eval_count") / spent).otherwise(0.0)).alias("tokens_per_s"))


def usage_stats(folded: DataFrame, name: str) -> DataFrame:
    """Token counts of the final metadata, 0 where it has none."""
    fields = ("prompt_tokens", "completion_tokens", "total_tokens") if name == "choices" else ("input_tokens", "output_tokens")
    return folded.select("stream_id", *(F.coalesce(F.col(f"metadata.usage.{f}"), F.lit(0)).alias(f) for f in fields))


def download_progress(chunks: DataFrame) -> DataFrame:
    """stream_id, seq, status, digest, the largest total so far, the last completed, and the chunk's own percentage."""
    w = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.select("stream_id", "seq", _c("status").alias("status"), _c("digest").alias("digest"), F.coalesce(F.max(_c("total")).over(w), F.lit(0)).alias("total"), F.coalesce(F.last(_c("completed"), ignorenulls=True).over(w), F.lit(0)).alias("completed"), F.when(_c("completed").isNotNull(), round2(percentage(_c("completed"), F.coalesce(_c("total"), F.lit(1))))).alias("percentage"))


def download_stats(chunks: DataFrame) -> DataFrame:
    """Of each download: last status, largest total, last completed, MB, how many updates, overall percentage."""
    some = _c("completed").isNotNull()
    totals = chunks.groupBy("stream_id").agg(F.max_by(_c("status"), "seq").alias("status"), F.coalesce(F.max(_c("total")), F.lit(0)).alias("total"), F.coalesce(F.max_by(F.when(some, _c("completed")), F.when(some, F.col("seq"))), F.lit(0)).alias("completed"), F.count_if(some).alias("updates"))
    return totals.select("*", round2(megabytes(F.col("completed"))).alias("mb"), round2(percentage(F.col("completed"), F.col("total"))).alias("percentage"))


def response_text(body: Column) -> Column:
    """message.content of a JSON body, stripped; the empty text for anything that is not one JSON object or lacks it."""

    @F.arrow_udf("string")
    def run(bodies: pa.Array) -> pa.Array:
        out = []
        for b in bodies.to_pylist():
            try:
                got = json.loads(b)["message"]["content"]
            except (ValueError, KeyError, TypeError):
                got = ""
            out.append(got.strip() if isinstance(got, str) else "")
        return pa.array(out, pa.string())

    return run(body)


def live_fold(lines: DataFrame, name: str, checkpoint: str, table: str):
    """Start folding a stream of lines (stream_id, seq, value) into an in-memory table, as far as there is input now."""
    return fold(parsed(lines, name), name).writeStream.format("memory").queryName(table).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Replay:
    """A stream's chunks, kept so that they can be read again; what is asked for is computed on demand."""

    def __init__(self, chunks: DataFrame, name: str):
        self.chunks, self.name = chunks.persist(), name

    def folded(self) -> DataFrame:
        return fold(self.chunks, self.name)

    def full_response(self, stream) -> str:
        row = self.folded().filter(F.col("stream_id") == stream).select("text").first()
        return row[0] if row else ""

    def metadata(self, stream) -> dict:
        row = self.folded().filter(F.col("stream_id") == stream).select("metadata").first()
        return row[0].asDict(recursive=True) if row and row[0] else {}

    def stats(self) -> DataFrame:
        if self.name == "download":
            return download_stats(self.chunks)
        return generate_stats(self.folded()) if self.name == "generate" else usage_stats(self.folded(), self.name)
