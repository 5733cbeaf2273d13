"""WARC archives: a writer that turns repeated payloads into revisits, and a splittable reader.

Archives are .warc.gz, one gzip member for each record. A read task gets a byte range of a file.
It scans the range for the gzip magic and takes a place for the start of a record only if the bytes
there inflate to WARC headers, the block is as long as they say, and the member ends at another
member's magic or at the end of the file; so compressed bytes that look like a member, or a
whole archive inside a payload, are passed over. A record belongs to the range that it starts in,
and is read to its end wherever that lies. Nothing is read twice but a record's tail.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm._shared import in_arrow

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Shorter payloads are always stored: a revisit would be no smaller.
LEAST = 100
BLOCK = 1 << 18


def filesystem(path: str):
    """Local paths, file:// and the other schemes that Arrow's file systems open on executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file:///{path.removeprefix('file:').lstrip('/')}")


def record(ident: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. refers_to: the id of the response that holds the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write_warc(df: DataFrame, where: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row under `where`; returns path, size of the archives.

    The payload is the html in UTF-8 (null: empty). Among equal payloads of at least LEAST bytes
    the row with the smallest key is the response and the others revisit it; equal keys are all the
    response, as is a null key. A null url has no target line; control characters and spaces of a
    url are percent-encoded. A task writes one archive under a name of its own attempt, and only
    the names that a finished task returns count. The payloads are shuffled once, by digest; a
    payload that many rows share is split by adaptive skew joins.
    """
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    # the first key of each payload that more than one row has
    sized = df.select(F.col(key).cast("bigint").alias("k"), F.sha2(payload, 256).alias("d"), F.octet_length(payload).alias("n"))
    first = sized.filter(F.col("n") >= LEAST).groupBy("d").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("d", "first")
    rows = rows.join(first, rows["digest"] == first["d"], "left")
    rows = rows.select("key", "url", "payload", "digest", F.when(F.col("first") < F.col("key"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, out, path, size = TaskContext.get(), None, "", 0
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                for r in batch.slice(low, 500).to_pylist():
                    if out is None:
                        files, top = filesystem(where)
                        files.create_dir(top, recursive=True)
                        path = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
                        out = files.open_output_stream(f"{top}/{path}", compression=None)
                    refers = r["refers_to"]
                    made = record(f"urn:page:{'null' if r['key'] is None else r['key']}", r["url"], r["payload"], r["digest"], None if refers is None else f"urn:page:{refers}", date)
                    out.write(made)
                    size += len(made)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{where}/{path}"], "size": [size]})

    done = in_arrow(rows, run, "path string, size bigint").collect()  # a row for each archive
    return df.sparkSession.createDataFrame(done, "path string, size bigint")


class Source:
    """Bytes of a file by position, in blocks; the last few stay."""

    def __init__(self, file, size: int):
        self.file, self.size, self.kept = file, size, {}

    def block(self, i: int) -> bytes:
        if i not in self.kept:
            if len(self.kept) > 3:
                self.kept.pop(next(iter(self.kept)))
            self.file.seek(i * BLOCK)
            self.kept[i] = self.file.read(min(BLOCK, self.size - i * BLOCK))
        return self.kept[i]

    def pieces(self, at: int) -> Iterator[bytes]:
        while at < self.size:
            got = self.block(at // BLOCK)[at % BLOCK :]
            if not got:
                raise EOFError(f"the file ends before its {self.size} bytes")
            yield got
            at += len(got)

    def take(self, at: int, n: int) -> bytes:
        got = b""
        for piece in self.pieces(at):
            got += piece[: n - len(got)]
            if len(got) == n:
                break
        return got


def member(source: Source, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """Headers and block of the record whose member starts at a position, and where it ends; None if none does."""
    unpack, data, head = zlib.decompressobj(31), bytearray(), -1
    try:
        for piece in source.pieces(at):
            data += unpack.decompress(piece)
            if data[:7] != b"WARC/1."[: len(data)]:
                return None
            if unpack.eof:
                at += len(piece) - len(unpack.unused_data)
                break
            at += len(piece)
    except zlib.error:
        return None
    if not unpack.eof or (head := data.find(b"\r\n\r\n")) < 0 or at < source.size and source.take(at, 3) != MAGIC:
        return None
    headers = {}
    for line in bytes(data[:head]).decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    if headers.get("content-length") != str(len(data) - head - 8):
        return None
    return headers, bytes(data[head + 4 : -4]), at


def records(source: Source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Every record that starts in [start, end)."""
    at = start
    while at < end:
        if source.take(at, 3) != MAGIC or (found := member(source, at)) is None:
            # not the start of a record: on to the next magic, which may lie across blocks
            at += 1
            while at < end:
                piece = source.block(at // BLOCK)
                i = piece.find(MAGIC, at % BLOCK)
                if i >= 0:
                    at = at // BLOCK * BLOCK + i
                    break
                edge = (at // BLOCK + 1) * BLOCK
                near = [p for p in range(max(at, edge - 2), edge) if source.take(p, 3) == MAGIC]
                at = near[0] if near else edge
                if near:
                    break
            continue
        headers, block, after = found
        yield at, headers, block
        at = after


FIELDS = {"path": "string", "offset": "bigint", "record_type": "string", "record_id": "string", "target_uri": "string", "refers_to_id": "string", "payload": "binary", "payload_bytes": "bigint", "payload_digest": "string"}


def read_warc(spark: SparkSession, archives: DataFrame, fields: tuple[str, ...] = tuple(FIELDS), split_bytes: int = 4 << 20) -> DataFrame:
    """The records of archives (path, size), fields of FIELDS, in ranges of split_bytes.

    payload_bytes and payload_digest are those of the stored payload; of a revisit, which stores
    none, those that its headers state. No archives: no rows.
    """
    ranges = archives.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes))).alias("low"))
    count = archives.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0] or 1
    schema = T._parse_datatype_string(", ".join(f"{f} {FIELDS[f]}" for f in fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        shape = pa.schema([(f, kinds[FIELDS[f]]) for f in fields])
        for batch in batches:
            for r in batch.to_pylist():
                files, at = filesystem(r["path"])
                held, weight = [], 0
                with files.open_input_file(at) as file:
                    for offset, headers, block in records(Source(file, r["size"]), r["low"], min(r["low"] + split_bytes, r["size"])):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length, digest = len(payload), ""
                        if headers.get("warc-type") == "revisit":
                            stated = re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)
                            length, digest = int(stated[1]) if stated else 0, headers.get("warc-payload-digest", "").removeprefix("sha256:")
                        else:
                            digest = hashlib.sha256(payload).hexdigest()
                        full = {"path": r["path"], "offset": offset, "record_type": headers.get("warc-type"), "record_id": headers.get("warc-record-id", "").strip("<>"), "target_uri": headers.get("warc-target-uri"), "refers_to_id": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None, "payload": payload, "payload_bytes": length, "payload_digest": digest}
                        held.append({f: full[f] for f in fields})
                        weight += len(payload) if "payload" in fields else 200
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, shape)
                            held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, shape)

    # a task may get several ranges, so that small ranges don't make a flood of tasks
    return in_arrow(ranges.repartition(min(int(count), max(spark.sparkContext.defaultParallelism * 4, int(count) // 64))), run, schema)
