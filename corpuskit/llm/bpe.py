"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is one last token that its encoding can end with. An automaton
over the vocabulary (a trie with suffix links) names the tokens that end at each byte, longest
first; the first one that is compatible with the last token of the prefix before it is the
answer. Back-pointers from the end give the ids. The work is linear in the bytes, also for one
word of a megabyte, where repeated merging is not.

Two tokens are compatible when merging by rank never joins across their boundary. Each token's
merges form a tree; along the boundary stand the right edge of the left tree and the left edge of
the right tree. A pair of edge nodes with a merge of its own breaks the boundary if that merge
comes before either node is swallowed by its parent (at equal rank the leftmost merge wins).
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm._shared import in_arrow
from corpuskit.llm.words import Memory, gathered, letters_and_marks, listed, parts_in, parts_of, slices

#: Fixed value: the pattern that byte-level tokenizers split a text with before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of one generation of a worker's memory, and pairs of tokens that it remembers; results do not depend on them.
CACHE = 150_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Vocabulary files write a byte as one printable character: itself if printable, else 256 and up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """A trie of the tokens with suffix links: after each byte, the longest token that ends there."""

    def __init__(self, tokens: Iterable[tuple[int, bytes]]):
        self.step: dict[int, int] = {}
        self.token = [-1]
        below: list[list[int]] = [[]]
        for ident, word in tokens:
            node = 0
            for b in word:
                nxt = self.step.get(node << 8 | b)
                if nxt is None:
                    nxt = self.step[node << 8 | b] = len(self.token)
                    self.token.append(-1)
                    below.append([])
                    below[node].append(b)
                node = nxt
            self.token[node] = ident
        #: The longest token that is a proper suffix of a token.
        self.shorter: dict[int, int] = {}
        self.back = [0] * len(self.token)
        queue = [self.step[b] for b in below[0]]
        for node in queue:
            own, inherited = self.token[node], self.token[self.back[node]]
            if own >= 0:
                self.shorter[own] = inherited
            else:
                self.token[node] = inherited
            for b in below[node]:
                child = self.step[node << 8 | b]
                self.back[child] = self._walk(self.back[node], b)
                queue.append(child)
        self.edges = len(self.step)

    def _walk(self, node: int, b: int) -> int:
        while (nxt := self.step.get(node << 8 | b)) is None:
            if not node:
                return 0
            node = self.back[node]
        return nxt

    def follow(self, node: int, b: int) -> int:
        """A transition off the trie, remembered while there is room."""
        nxt = self._walk(node, b)
        if len(self.step) < 4 * self.edges:
            self.step[node << 8 | b] = nxt
        return nxt


class Codec:
    """Encoder and decoder of one vocabulary file; ids are packed as little-endian uint32."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True) and not spec.get("normalizer")
        odd = any(model.get(x) for x in ("end_of_word_suffix", "continuing_subword_prefix", "dropout", "unk_token", "byte_fallback", "ignore_merges"))
        if not plain or odd or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in spec["added_tokens"]):
            raise ValueError(f"{path}: not a plain byte-level vocabulary")
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        vocab = model["vocab"]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(merges)}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.halves.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        self.right_edge, self.left_edge = {}, {}
        self.known: dict[int, bool] = {}
        usable = [(i, w) for i, w in self.bytes_of.items() if i not in self.halves or self._whole(i)]
        self.automaton = Automaton(usable)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(PATTERN)
        self.odd_space = re.compile(r" (?:\s|\Z)")
        self.memory = Memory(CACHE)
        self.text_of = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.size_of = [len(x) for x in self.text_of]
        self.texts = pa.array(self.text_of, pa.large_binary())

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(node, rank at which its parent swallows it) from the whole token down one side."""
        kept = (self.left_edge, self.right_edge)[side]
        if token not in kept:
            nodes, until = [(token, NEVER)], NEVER
            while (found := self.halves.get(nodes[-1][0])) is not None:
                until = found[2]
                nodes.append((found[side], until))
            kept[token] = nodes
        return kept[token]

    def _broken(self, left: int, right: int, within: int = NEVER) -> bool:
        rank, heads = self.rank, self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            x_until = min(x_until, within)
            for y, y_until in heads:
                r = rank.get((x, y))
                if r is not None and r < x_until and (r <= y_until if y_until < within else r < within):
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Does the token's own text encode to it: nothing joins its halves' inner parts earlier."""
        left, right, rank = self.halves[token]
        return not self._broken(left, right, rank)

    def compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[key] = not self._broken(left, right)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        step, token, shorter, known = self.automaton.step, self.automaton.token, self.automaton.shorter, self.known
        size, node, last = self.size_of, 0, [-1]
        for i, b in enumerate(word, 1):
            nxt = step.get(node << 8 | b)
            node = self.automaton.follow(node, b) if nxt is None else nxt
            ends = token[node]
            while ends >= 0:
                before = i - size[ends]
                if not before:
                    break
                fits = known.get(last[before] << 32 | ends)
                if fits or fits is None and self.compatible(last[before], ends):
                    break
                ends = shorter[ends]
            else:
                raise ValueError("the vocabulary has no token for a byte")
            last.append(ends)
        ids, i = [], len(word)
        while i:
            ids.append(last[i])
            i -= size[last[i]]
        return ids[::-1]

    def _piece(self, piece: bytes) -> bytes:
        """The ids of one piece that PATTERN splits off."""
        found = self.encode_word(piece)
        return struct.pack(f"<{len(found)}I", *found)

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        return [self._piece(p) if p else b"" for p in pieces]

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of chunks, each of which begins with its space."""
        return [self._plain(c.decode(errors="replace")) for c in chunks]

    def _plain(self, text: str) -> bytes:
        pieces = [w.encode() for w in self.words.findall(text)]
        kinds = list(dict.fromkeys(pieces))
        return b"".join(map(dict(zip(kinds, self.memory.look_up(kinds, self._pieces), strict=True)).__getitem__, pieces))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, memoryview]:
        """(starts, packed ids): text i has the ids starts[i] to starts[i + 1]. Null texts are empty; bytes that are no UTF-8 count as U+FFFD.

        A space before a character that is no white space always starts a piece, so a text falls into
        chunks at its spaces, and each distinct chunk is encoded once. What stands before the first
        space is encoded by itself, as are texts with special tokens or spaces before white space.
        """
        raw = pc.fill_null(texts.cast(pa.binary()), b"")
        read = [t.decode(errors="replace") for t in listed(raw)]
        long = np.array([bool(self.odd_space.search(t) or self.at_special and self.at_special.search(t)) for t in read], bool)
        chunks = pc.split_pattern(pc.if_else(pa.array(long), pa.scalar(b"", pa.binary()), raw).view(pa.string()), pattern=" ")
        starts = np.asarray(chunks.offsets).astype(np.int64)
        found = chunks.values[starts[0] : starts[-1]].dictionary_encode()
        starts -= starts[0]
        words, codes = found.dictionary.view(pa.binary()), found.indices.to_numpy(zero_copy_only=False)
        plain, letters, marks = letters_and_marks(words)
        space, none = pa.scalar(" "), pa.scalar("")
        alone = pc.equal(letters, none)  # marks behind a space
        heads, tails = pc.binary_join_element_wise(space, pc.if_else(alone, marks, letters), none), pc.if_else(alone, none, marks)
        others = pc.binary_join_element_wise(space, words.view(pa.string()).filter(pa.array(~plain)), none).view(pa.binary())
        parts, places = parts_of(codes, plain, heads, tails, others, self.memory, self._pieces, self._chunks)
        firsts = [self.encode(t) if by_itself else self._plain(t.split(" ", 1)[0]) for t, by_itself in zip(read, long.tolist(), strict=True)]
        first = 2 * starts[:-1]
        places[first], places[first + 1] = np.arange(len(firsts)) + len(parts), 0
        at, packed = gathered(parts + firsts, places)
        return at[2 * starts] // 4, packed

    def decode_all(self, starts: np.ndarray, packed: memoryview) -> list[bytes]:
        """The UTF-8 of each list of ids, starts as of encode_all."""
        taken = self.texts.take(pa.array(np.frombuffer(packed, "<u4")))
        at, raw = parts_in(taken)
        return [valid(bytes(raw[a:b])) for a, b in zip(at[starts[:-1]].tolist(), at[starts[1:]].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        return b"".join(struct.pack("<I", self.special[part]) if part in self.special else self._plain(part) for part in self.at_special.split(text))

    def decode(self, packed: bytes) -> bytes:
        """The UTF-8 of the text."""
        return valid(b"".join(map(self.text_of.__getitem__, np.frombuffer(packed, "<u4").tolist())))


def valid(raw: bytes) -> bytes:
    """raw, with U+FFFD for bytes that are no UTF-8."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()
    return raw


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: What bpe() can return for a text.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def bpe(df: DataFrame, path: str, text: str = "text", outputs: tuple[str, ...] = ("ids",), keep_text: bool = True) -> DataFrame:
    """df with the encoding of a text column, and its decoding again, one row for a row.

    path: a byte-level vocabulary in JSON, readable on every executor. outputs: of OUTPUTS; the
    digests are of the ids as little-endian uint32 and of the decoded UTF-8. A null text counts as
    empty: no ids, decoded "". Other columns pass; one that is named as an output is replaced.
    Texts are encoded whole. No shuffle; a worker holds a few megabytes of text at a time, or one
    longer text, and bounded memories.
    """
    keep = [c for c in df.columns if c not in outputs]
    kept = [c for c in keep if c != text]
    source = df.select(*kept, F.col(text).alias(text))
    keep_text = keep_text and text not in outputs
    schema = T.StructType([*(source.schema[c] for c in kept), *([df.schema[text]] if keep_text else []), *(T.StructField(o, T._parse_datatype_string(OUTPUTS[o])) for o in outputs)])
    back = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for low, n in slices(batch.column(len(kept))):
                piece = batch.slice(low, n)
                texts = piece.column(len(kept))
                starts, packed = own.encode_all(texts)
                raw = own.decode_all(starts, packed) if back else []
                ends = zip((4 * starts[:-1]).tolist(), (4 * starts[1:]).tolist(), strict=True)
                made = {
                    "ids": lambda: pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.frombuffer(packed, "<i4"), pa.int32())),
                    "n_tokens": lambda: pa.array(np.diff(starts), pa.int64()),
                    "ids_sha256": lambda: pa.array([hashlib.sha256(packed[a:b]).hexdigest() for a, b in ends], pa.string()),
                    "decoded": lambda: pa.array(raw, pa.binary()).cast(pa.string()),
                    "decoded_sha256": lambda: pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(kept)], *([texts] if keep_text else []), *(made[o]() for o in outputs)], names=schema.names)

    return in_arrow(source, run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", output: str = "text") -> DataFrame:
    """df with the text of a column of ids. Null ids give null, no ids the empty text."""
    kept = [c for c in df.columns if c not in (output, ids)]
    source = df.select(*kept, F.col(ids).cast("array<int>").alias(ids))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(output, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = [None if x is None else own.decode(np.array(x, "<u4").tobytes()).decode() for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(rows, pa.string())], names=schema.names)

    return in_arrow(source, run, schema)
