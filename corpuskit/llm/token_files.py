"""Token ids as Parquet files that can be read selectively.

Layout of a file: rows in ascending key order, columns key, part (the file's number), local_start
(ids before the row in its file), n_tokens and ids, a list of int32. The ids are dictionary encoded
(bit-packed indices of at most 17 bits for these vocabularies; a column chunk whose dictionary
outgrows its page falls back to delta encoding, Parquet 2), row groups and pages are small and fixed
by parameters, and the page index lets a reader touch only the pages of the keys that it asks for.
Metadata queries read no ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm._shared import in_arrow
from corpuskit.llm.bpe import byte_alphabet
from corpuskit.llm.words import MARKS, Memory, gathered, letters_and_marks, parts_of, slices, split

#: Words of one generation of a worker's memory; two are kept, and results do not depend on them.
CACHE = 150_000
#: The last Latin letter that is one character, whose lower case is one as well.
LATIN = "\u024f"
#: What the vocabulary files that this serves do to a text before their model.
NORMAL = [("NFC", None), ("Replace", {"Regex": "\\s+"}), ("Lowercase", None)]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def drops_white_space(spec: dict) -> bool:
    """Is a vocabulary file one that lower-cases, parts a text at white space and drops it, and then splits into letters, digits and marks."""
    before, steps = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    normal = [(x.get("type"), x.get("pattern")) for x in before.get("normalizers", [])]
    return (
        normal == NORMAL
        and before["normalizers"][1].get("content") == " "
        and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
        and (steps[0]["pattern"], steps[0]["behavior"], steps[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
        and spec["model"]["type"] == "BPE"
        and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", []))
    )


class Words:
    """Ids of words between ASCII white space, by the tokenizers library, packed as uint32.

    The vocabularies this serves drop white space and never join across it, so a text's ids are
    those of its words one after the other; other files are refused.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            if not drops_white_space(json.load(file)):
                raise ValueError(f"{path}: not a vocabulary that drops white space")
        self.library = Tokenizer.from_file(path)
        self.memory = Memory(CACHE)
        #: Bytes as the characters that the vocabulary writes for them.
        self.written = {b: c for c, b in byte_alphabet().items()}

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        """What the library's model makes of letters in lower case, or of marks, without its steps before that, which leave them as they are."""
        model, written = self.library.model.tokenize, self.written
        ids, ends = [], [0]
        for p in pieces:
            if p:
                ids += [t.id for t in model(p.decode() if p.isascii() else p.decode("latin-1").translate(written))]
            ends.append(4 * len(ids))
        packed = np.array(ids, "<u4").tobytes()
        return [packed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _whole(self, words: list[bytes]) -> list[bytes]:
        """Words of Latin letters with marks behind in these two pieces; any other word by itself."""
        out, heads, tails, other = [b""] * len(words), [], [], []
        for i, word in enumerate(words):
            text = word.decode(errors="replace")
            letters = text.rstrip(MARKS)
            low = letters.lower()
            if letters and letters.isalpha() and low.isalpha() and max(low) <= LATIN:
                heads.append((i, low.encode()))
                tails.append(text[len(letters) :].encode())
            else:
                other.append((i, text))
        kinds = list(dict.fromkeys(tails))
        marks = dict(zip(kinds, self._pieces(kinds), strict=True))
        for (i, _), head, tail in zip(heads, self._pieces([h for _, h in heads]), tails, strict=True):
            out[i] = head + marks[tail]
        for (i, _), found in zip(other, self.library.encode_batch_fast([t for _, t in other], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """(starts, ids): text i has the ids[starts[i] : starts[i + 1]], `end` last. Null texts are empty; bytes that are no UTF-8 count as U+FFFD."""
        starts, codes, words = split(texts)
        plain, letters, marks = letters_and_marks(words)
        parts, places = parts_of(codes, plain, pc.ascii_lower(letters), marks, words.filter(pa.array(~plain)), self.memory, self._pieces, self._whole)
        at, packed = gathered([*parts, end], np.insert(places, 2 * starts[1:], len(parts)))
        return at[2 * starts + np.arange(len(starts))] // 4, np.frombuffer(packed, "<i4")


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def write_token_files(df: DataFrame, where: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int | None = 1, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10, page_rows: int = 500) -> None:
    """Encode every whole text and write the files, in ascending key order over all files.

    Null texts count as empty (the end id alone). Null keys come first; rows of one key are
    ordered by a hash of their text, and repeated rows are written as often as they come. No rows:
    no files with rows. One range shuffle of the texts; encoding follows it in the same stage as
    the writing, and holds a few megabytes of text at a time, or one longer text. tokenizer: a
    vocabulary file that drops white space; any other is an error.
    """
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    rows = rows.withColumn("tie", F.xxhash64("raw")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("part", T.IntegerType()), T.StructField("local_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, start = words_of(tokenizer), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for low, n in slices(batch.column("raw")):
                piece = batch.slice(low, n)
                at, ids = own.encode(piece.column("raw"), end)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(np.full(n, part), pa.int32()), pa.array(start + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), lists], names=schema.names)
                start += int(at[-1])

    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.enable.dictionary": "true", "parquet.writer.version": "v2", "compression": "snappy"}
    writer = in_arrow(rows.select("key", "raw"), run, schema).write
    for name, value in options.items():
        writer = writer.option(name, str(value))
    writer.parquet(where)


#: Offsets of up to so many files (16 bytes each) are broadcast; of more, joined by a shuffle.
BROADCAST_FILES = 1_000_000


def read_token_files(spark: SparkSession, where: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """key, start, n_tokens, ids of the files, or of keys between low and high: then only their
    row groups and pages are read. start counts the ids of all rows before, over all files.

    The files' totals go through the driver: one row for each file.
    """
    files = spark.read.parquet(where)
    totals = sorted(map(tuple, files.groupBy("part").agg(F.sum("n_tokens")).collect()))
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    if low is not None:
        files = files.filter(F.col("key") >= low)
    if high is not None:
        files = files.filter(F.col("key") <= high)
    starts = spark.createDataFrame(offsets, "part int, part_start bigint")
    if len(offsets) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return files.join(starts, "part").select("key", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def with_crc32(df: DataFrame, ids: str = "ids", output: str = "ids_crc32") -> DataFrame:
    """Replace a column of ids by the unsigned CRC-32 of them as little-endian uint32; null gives null."""
    kept = [c for c in df.columns if c not in (ids, output)]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(output, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(kept))
            ends, values = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(crcs, pa.int64(), mask=np.array(lists.is_null()))], names=schema.names)

    return in_arrow(df.select(*kept, ids), run, schema)
