"""Words of whole columns of texts, split and told apart by Arrow's kernels, so that Python sees each distinct word of a slice once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split together; a longer text stands alone.
SLICE = 2 << 20
#: Longer words are never remembered.
LONGEST = 64


def lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def listed(column: pa.Array) -> list:
    """The values as Python objects, much faster than one scalar after the other."""
    return column.to_numpy(zero_copy_only=False).tolist()


def slices(texts: pa.Array, most: int = SLICE, rows: int = 5000) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of texts of about so many bytes together."""
    ends, low = np.cumsum(lengths(texts)), 0
    while low < len(texts):
        before = int(ends[low - 1]) if low else 0
        high = min(max(low + 1, int(np.searchsorted(ends, before + most, side="right"))), low + rows, len(texts))
        yield low, high - low
        low = high


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(starts, codes, words): text i has the words[codes[starts[i] : starts[i + 1]]].

    Words are runs of bytes other than ASCII white space, A-Z lower-cased if asked for; null texts
    have none. Bytes need not be UTF-8.
    """
    strings = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())
    lists = pc.ascii_split_whitespace(pc.ascii_lower(strings) if lower else strings)
    starts = np.asarray(lists.offsets).astype(np.int64)
    found = lists.values[starts[0] : starts[-1]].dictionary_encode()
    codes, words = found.indices.to_numpy(zero_copy_only=False), found.dictionary
    starts = starts - starts[0]
    empty = pc.index(words, pa.scalar("", words.type)).as_py()  # before, behind and instead of words
    if empty >= 0:
        kept = codes != empty
        starts = np.concatenate([[0], np.cumsum(kept)])[starts]
        codes = codes[kept]
    return starts, codes, words.view(pa.binary())


def parts_in(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Of a large_binary column: where each value begins (and the last ends) in its bytes, and the bytes."""
    if not len(column):
        return np.zeros(1, np.int64), memoryview(b"")
    starts = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return starts - starts[0], memoryview(column.buffers()[2] or b"").cast("B")[int(starts[0]) : int(starts[-1])]


def gathered(parts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The parts at places, one after the other: where each begins (and the last ends), and the bytes."""
    return parts_in(pa.array(parts, pa.large_binary()).take(pa.array(places)))


class Memory:
    """What has been found for words, bounded: two generations of about `size` words each. When the young
    one is full the old one is dropped; what is asked for again moves on. Results never depend on it."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def look_up(self, words: list, learn: Callable[[list], list]) -> list:
        """What is known of each of the distinct words; learn() gets those not known."""
        found, missing, old = list(map(self.young.get, words)), [], self.old.get
        for i, x in enumerate(found):
            if x is None:
                x = found[i] = old(words[i])
                if x is None:
                    missing.append(i)
                else:
                    self.young[words[i]] = x
        if missing:
            for i, x in zip(missing, learn([words[i] for i in missing]), strict=True):
                found[i] = x
                if len(words[i]) <= LONGEST:
                    self.young[words[i]] = x
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        return found


#: ASCII letters, and the ASCII characters that are neither letters, digits nor white space.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def letters_and_marks(words: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """(plain, letters, marks): plain words are ASCII letters with ASCII marks behind them, either of which may be missing; their two parts."""
    strings = words.view(pa.string())
    letters, marks = pc.ascii_rtrim(strings, characters=MARKS), pc.ascii_ltrim(strings, characters=LETTERS)
    plain = lengths(letters) + lengths(marks) == lengths(strings)  # what is in between would count twice
    return plain, letters.filter(pa.array(plain)), marks.filter(pa.array(plain))


def parts_of(codes: np.ndarray, plain: np.ndarray, heads: pa.Array, tails: pa.Array, others: pa.Array, memory: Memory, piece: Callable[[list[bytes]], list[bytes]], whole: Callable[[list[bytes]], list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    """(parts, places): word codes[i] is parts[places[2 * i]] and then parts[places[2 * i + 1]].

    Of a plain word these are what piece() makes of its head and its tail; of the others, in their
    order, what whole() makes of them and nothing. All of it is remembered. parts[0] is nothing."""
    parts, place = [b""], np.zeros((len(plain), 2), np.int32)
    for side, column in enumerate((heads, tails)):
        found = column.dictionary_encode()
        place[plain, side] = found.indices.to_numpy(zero_copy_only=False) + len(parts)
        parts += memory.look_up(listed(found.dictionary.view(pa.binary())), piece)
    place[~plain, 0] = np.arange(len(others)) + len(parts)
    parts += memory.look_up(listed(others), whole)
    return parts, place[codes].ravel()
