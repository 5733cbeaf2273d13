"""A hidden Markov language model over words, trained and applied in partitions.

Latent states emit classes of words. The most frequent words are a class each; every other word, known
or not, falls into one of TAIL classes by its last letters, and inside a class a known word has its
share of the class's count. Unknown words share what the words seen once make likely, evenly among as
many unknown words as the words seen once and twice make likely (Chao's estimate). So P(word | state) =
P(class | state) * P(word | class), which sums to one over the known words and that many unknown ones
in each class; the end of a text is a class as well.

Baum-Welch: the states start from all training documents, parted by the words that occur together in
them; then each round runs the scaled forward and backward recursions over every training document,
kept as classes of its words, and the expected counts of transitions and emissions are summed across
partitions, until a round gains less than GAIN. Rounds run in single precision, as their emissions are
taken relative to the likeliest state's; a text's score is its exact likelihood by the forward
recursion in double precision. Texts are batched by length, so one step of the recursion serves many texts.

Counts of words cover all training documents. Only the LOOKUP most frequent are broadcast; a text's
other words are joined with their counts by a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._shared import dropped, in_arrow, written
from corpuskit.llm.words import listed, slices, split

STATES, HEAD, TAIL, LOOKUP = 6, 20_000, 4096, 200_000
#: Rounds over all training documents: at most so many, and none after one that gains less than GAIN log10 a token.
ROUNDS, GAIN = 14, 0.002
#: Features of a text for the start: of the head's words and of the tail's classes.
WORDS, TAILS = 192, 64
#: Steps of a recursion from one scaling to the next, at most.
STEPS = 4
#: Words that a task counts before it passes its counts on; tokens whose recursions run together.
DISTINCT, TOKENS = 250_000, 300_000
#: Weight, in tokens, of the corpus-wide class frequencies in a state's.
PRIOR = 50.0
END = b""


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


class Classes(dict):
    """The head's words to their classes; any other word has one by its last letters."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(head))
        #: The classes: the head's, the tail's, the end.
        self.first, self.end = len(head), len(head) + TAIL

    def __reduce__(self):
        return Classes, (sorted(self, key=self.get),)

    def of(self, words: list[bytes]) -> np.ndarray:
        first, get = self.first, self.get
        return np.fromiter((first + tail_class(w) if (k := get(w)) is None else k for w in words), np.int32, len(words))

    def sequences(self, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, list[bytes]]]:
        """Slices of texts: (first row, the classes of each text and its end, starts and codes of its words, the distinct words)."""
        for low, n in slices(texts):
            starts, codes, words = split(texts.slice(low, n), lower=True)
            words = listed(words)
            flat = np.insert(self.of(words)[codes] if len(words) else np.zeros(0, np.int32), starts[1:], self.end)
            ends = (starts + np.arange(n + 1)).tolist()
            yield low, [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], starts, codes, words


class Batch:
    """Sequences of classes, longest first, laid out step by step."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        #: Steps at whose end the probabilities are scaled: after a few, and where a sequence ends.
        self.scaled = ((np.arange(len(self.active)) % STEPS == STEPS - 1) | (np.diff(self.active, append=0) < 0)).tolist()
        self.seen = np.empty(self.start[-1], np.int32)
        for i, at in enumerate(self.order):
            self.seen[self.start[: lengths[i]] + i] = sequences[at]
        self.row = np.concatenate([np.arange(n) for n in self.active]) if len(self.active) < 200 else np.arange(self.start[-1]) - np.repeat(self.start[:-1], self.active)

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """The scaled states' probabilities (states by places), and the scales, 1 where there is none."""
        alpha = model.emit.take(self.seen, 1)
        scale = np.ones(len(self.seen), alpha.dtype)
        move, start, last = np.ascontiguousarray(model.move.T), self.start.tolist(), None
        for low, high, scaled in zip(start, start[1:], self.scaled, strict=False):
            a = alpha[:, low:high]
            a *= model.first[:, None] if last is None else move @ last[:, : high - low]
            if scaled:
                a /= a.sum(0, out=scale[low:high])
            last = a
        return alpha, scale

    def log10(self, model: Model) -> np.ndarray:
        """log10 likelihood of each sequence, in the order they came in."""
        _, scale = self.forward(model)
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.row, np.log10(scale) + model.most[self.seen], len(self.order))
        return out

    def expect(self, model: Model, counts: Counts) -> None:
        alpha, scale = self.forward(model)
        counts.value += float(np.log10(scale).sum(dtype=float) + model.most[self.seen].sum())
        ahead = model.emit.take(self.seen, 1)
        ahead /= scale
        beta, start = np.ones_like(alpha), self.start.tolist()
        for here, low, high in zip(start[-3::-1], start[-2::-1], start[:0:-1], strict=False):
            a = ahead[:, low:high]
            a *= beta[:, low:high]
            beta[:, here : here + high - low] = model.move @ a
        if len(self.active) > 1:
            before = np.arange(start[1], start[-1]) - np.repeat(self.active[:-1], self.active[1:])
            counts.move += model.move * (alpha.take(before, 1) @ ahead[:, start[1] :].T)
        alpha *= beta
        counts.first += alpha[:, : self.active[0]].sum(1)
        for k, gamma in enumerate(alpha):
            counts.emit[k] += np.bincount(self.seen, gamma, counts.emit.shape[1])


class Model:
    """first: of each state at the start; move: from state to state; emit: of each class in each state, as
    a part of what the likeliest state has, whose log10 is in most."""

    def __init__(self, first: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.first, self.move = first, move
        most = emit.max(0)
        self.emit, self.most = emit / most, np.log10(most)

    def single(self) -> Model:
        """In single precision, for rounds of training."""
        out = object.__new__(Model)
        out.first, out.move, out.emit, out.most = self.first.astype(np.float32), self.move.astype(np.float32), self.emit.astype(np.float32), self.most
        return out


class Counts:
    def __init__(self, states: int, classes: int):
        self.first, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        #: The log10 likelihood of what was counted.
        self.value = 0.0

    def model(self, overall: np.ndarray) -> Model:
        """The maximising parameters, with a little of the overall class frequencies in every state."""
        emit = self.emit + PRIOR * overall
        move, first = self.move + 1.0, self.first + 1.0
        return Model(first / first.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def batches(sequences: list[np.ndarray]) -> Iterator[tuple[list[int], Batch]]:
    """Places and batches of sequences of like length."""
    held, size = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        if held and size + len(sequences[i]) > TOKENS:
            yield held, Batch([sequences[j] for j in held])
            held, size = [], 0
        held.append(i)
        size += len(sequences[i])
    if held:
        yield held, Batch([sequences[j] for j in held])


def count_words(docs: DataFrame) -> DataFrame:
    """word, n over all documents; the end of each counts as the empty word."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(found.keys()), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for part in parts:
            found[END] += part.num_rows
            for low, n in slices(part.column("raw")):
                _, codes, words = split(part.column("raw").slice(low, n), lower=True)
                found.update(dict(zip(listed(words), np.bincount(codes, minlength=len(words)).tolist(), strict=True)))
                if len(found) > DISTINCT:
                    yield out()
        yield out()

    return in_arrow(docs.select("raw"), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


class Language:
    """Everything that scoring needs on the executors, of bounded size: HEAD, TAIL and LOOKUP."""

    def __init__(self, tokens: int, types: int, lookup: dict[bytes, int], head: list[bytes], sums: np.ndarray, once: np.ndarray, twice: np.ndarray, ends: int):
        self.tokens, self.types, self.lookup, self.ends = tokens, types, lookup, ends
        self.classes = Classes(head)
        #: Of each tail class: the count of its known words, the weight of all unknown ones, and of each.
        self.sums, self.unknown = sums, once + 0.5
        self.novel = self.unknown / (1 + once * once / (2 * (twice + 1)))
        known = np.array([lookup[w] for w in head], float)
        overall = np.concatenate([known, sums + self.unknown, [ends + 0.5]])
        self.overall = overall / overall.sum()
        self.model: Model | None = None
        self.rounds = 0


def _classes(docs: DataFrame, language: Language, held: list[str]) -> DataFrame:
    """classes: of each document, those of its words and its end, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(language.classes)
    kind = np.min_scalar_type(language.classes.end)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, found, *_ in shared.value.sequences(part.column("raw")):
                yield pa.RecordBatch.from_arrays([pa.array([s.astype(kind).tobytes() for s in found], pa.binary())], names=["classes"])

    return written(in_arrow(docs.select("raw"), run, "classes binary"), "classes", held)


def _summed(texts: DataFrame, language: Language, given: object, size: int, count: Callable[[object, list[np.ndarray], Counts], None]) -> Counts:
    """What count adds up over all texts, in counts of so many states; from each partition, a row for each class it has."""
    shared = texts.sparkSession.sparkContext.broadcast(given)
    n, columns, kind = len(language.overall), [f"s{k}" for k in range(size)], np.min_scalar_type(language.classes.end)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(size, n)
        for part in parts:
            count(shared.value, [np.frombuffer(raw.as_py(), kind) for raw in part.column("classes")], counts)
        some = np.nonzero(counts.emit.any(0))[0]
        rows = np.concatenate([counts.emit[:, some].T, counts.move, counts.first[None], np.full((1, size), counts.value)])
        place = np.concatenate([some, n + np.arange(size + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), *(pa.array(rows[:, k]) for k in range(size))], names=["place", *columns])

    got = in_arrow(texts, run, "place bigint, " + ", ".join(f"{c} double" for c in columns))
    counts = Counts(size, n)
    for row in got.groupBy("place").agg(*(F.sum(c).alias(c) for c in columns)).toLocalIterator():
        values = np.array(row[1:])
        if row["place"] < n:
            counts.emit[:, row["place"]] = values
        elif row["place"] < n + size:
            counts.move[row["place"] - n] = values
        elif row["place"] == n + size:
            counts.first = values
        else:
            counts.value = values[0]
    shared.destroy()
    return counts


def _expected(texts: DataFrame, language: Language) -> Counts:
    """The expected counts over all texts."""

    def count(model: Model, sequences: list[np.ndarray], counts: Counts) -> None:
        for _, batch in batches(sequences):
            batch.expect(model, counts)

    return _summed(texts, language, language.model.single(), STATES, count)


def features(sequences: list[np.ndarray], first: int) -> np.ndarray:
    """Of each text, how often it has words of each feature, scaled to length one."""
    out = np.zeros((len(sequences), WORDS + TAILS))
    for i, s in enumerate(sequences):
        words = s[:-1].astype(np.int64)
        out[i] = np.bincount(np.where(words < first, words % WORDS, WORDS + words % TAILS), minlength=WORDS + TAILS)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _together(texts: DataFrame, first: int, kind: np.dtype) -> np.ndarray:
    """How much each two features share texts, over all texts."""
    size = WORDS + TAILS

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((size, size))
        for part in parts:
            for low in range(0, part.num_rows, 1000):
                x = features([np.frombuffer(raw.as_py(), kind) for raw in part.column("classes")[low : low + 1000]], first)
                sums += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(sums.ravel())], names=["place", "x"])

    out = np.zeros(size * size)
    for place, x in in_arrow(texts, run, "place bigint, x double").groupBy("place").agg(F.sum("x")).toLocalIterator():
        out[place] = x
    return out.reshape(size, size)


def _start(texts: DataFrame, language: Language) -> Model:
    """States from all texts: those nearest to each of a few features that share the fewest texts."""
    first = language.classes.first
    near = _together(texts, first, np.min_scalar_type(language.classes.end))
    mass = near.sum(1)
    common = np.nonzero(mass >= np.median(mass[mass > 0]))[0] if mass.any() else []
    counts = Counts(STATES, len(language.overall))
    if len(common):
        near = near[common] / np.linalg.norm(near[common], axis=1, keepdims=True)
        seeds = [int(mass[common].argmax())]
        while len(seeds) < STATES:
            seeds.append(int((near @ near[seeds].T).max(1).argmin()))

        def count(given: np.ndarray, sequences: list[np.ndarray], counts: Counts) -> None:
            for low in range(0, len(sequences), 1000):
                some = sequences[low : low + 1000]
                for s, k in zip(some, (features(some, first) @ given.T).argmax(1), strict=True):
                    np.add.at(counts.emit[k], s, 1.0)
                    counts.first[k] += 1

        counts = _summed(texts, language, near[seeds], STATES, count)
        counts.move = np.eye(STATES) * 20
    counts.emit += np.random.default_rng(5).random(counts.emit.shape) * 0.01
    return counts.model(language.overall)


def fit(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Language, DataFrame]:
    """A language model of docs (raw: the UTF-8 of a text, null: empty), and the table of all words' counts."""
    vocabulary = written(count_words(docs), "vocabulary")
    totals = vocabulary.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.col("word") == END, F.col("c")))).first()
    # the most frequent words by a threshold on their counts, so that no task sends words beyond it; of the
    # step of counts at the threshold, those with the smallest hashes
    words = vocabulary.filter(F.octet_length("word") > 0).withColumn("step", F.floor(F.log2("c") * 64))
    steps, room, least, part = sorted(map(tuple, words.groupBy("step").count().collect()), reverse=True), LOOKUP, None, 0.0
    for step, n in steps:
        least, part = step, min(1.0, room / n)
        room -= n
        if room <= 0:
            break
    share = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    top = [] if least is None else [(bytes(r[0]), r[1]) for r in words.filter((F.col("step") > least) | (F.col("step") == least) & (share < part)).select("word", "c").collect()]
    top.sort(key=lambda x: (-x[1], x[0]))
    head = [w for w, _ in top[:HEAD]]
    shared = docs.sparkSession.sparkContext.broadcast(set(head) | {END})

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, TAIL))
        for part in parts:
            for word, c in zip(listed(part.column(0)), part.column(1).to_pylist(), strict=True):
                if word not in shared.value:
                    k = tail_class(word)
                    sums[0, k] += c
                    if c <= 2:
                        sums[c, k] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAIL), pa.int64()), *map(pa.array, sums)], names=["k", "total", "once", "twice"])

    sums = np.zeros((3, TAIL))
    for row in in_arrow(vocabulary.select("word", "c"), run, "k bigint, total double, once double, twice double").groupBy("k").agg(F.sum("total"), F.sum("once"), F.sum("twice")).collect():
        sums[:, row[0]] = row[1:]
    language, held = Language(int(totals[0] or 0), int(totals[1]), dict(top), head, *sums, int(totals[2] or 0)), []
    texts = _classes(docs, language, held)
    language.model, before = _start(texts, language), -np.inf
    for _ in range(rounds):
        counts = _expected(texts, language)
        language.model, now = counts.model(language.overall), counts.value / max(language.tokens, 1)
        language.rounds += 1
        if now - before < GAIN:
            break
        before = now
    dropped(docs.sparkSession, held)
    return language, vocabulary


def score(docs: DataFrame, language: Language, vocabulary: DataFrame) -> DataFrame:
    """docs, but for raw, with n_tokens, n_known, base_score and score.

    A first pass runs the recursion and adds up what the broadcast counts answer; the other words
    of a text go to a join with the vocabulary. Rows are told apart by a number of their own, so
    repeated rows stay.
    """
    kept = [c for c in docs.columns if c != "raw"]
    shared = docs.sparkSession.sparkContext.broadcast(language)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    schema += ", row bigint, n_tokens bigint, n_known bigint, base_score double, score double, rest array<struct<word: binary, n: bigint, unknown: double>>"
    bottom = float(np.log10(language.tokens + language.types + 1))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, number = shared.value, TaskContext.get().partitionId() << 34
        first, tails = own.classes.first, own.unknown + own.sums
        # log10 of a head word's share of its class is 0; of a tail class, what all its words have in common
        common, novel = -np.log10(tails), np.log10(own.novel)
        end = float(np.log10(own.ends + 1))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64()), ("unknown", pa.float64())]))]
        for part in parts:
            for low, sequences, starts, codes, words in own.classes.sequences(part.column(len(kept))):
                classes = own.classes.of(words)
                seen = np.fromiter((own.lookup.get(w, 0) for w in words), np.int64, len(words))
                with np.errstate(divide="ignore"):
                    share = np.where(classes < first, 0.0, common[np.maximum(classes - first, 0)] + np.where(seen > 0, np.log10(seen), 0.0))
                base = np.where(seen > 0, np.log10(seen + 1), 0.0)
                rows = []
                for s, a, b in zip(sequences, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    mine = codes[a:b]
                    some, times = np.unique(mine[seen[mine] == 0], return_counts=True)
                    rest = [{"word": words[i], "n": n, "unknown": float(novel[classes[i] - first])} for i, n in zip(some.tolist(), times.tolist(), strict=True)]
                    rows.append([number, len(s), int((seen[mine] > 0).sum()) + (own.ends > 0), float(base[mine].sum()) + end - bottom * len(s), float(share[mine].sum()), rest])
                    number += 1
                for places, batch in batches(sequences):
                    for i, value in zip(places, batch.log10(own.model).tolist(), strict=True):
                        rows[i][4] += value
                yield pa.RecordBatch.from_arrays([*part.slice(low, len(rows)).columns[: len(kept)], *(pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds))], names=[*kept, "row", "n_tokens", "n_known", "base_score", "score", "rest"])

    first = written(in_arrow(docs.select(*kept, "raw"), run, schema), "scores")
    rest = first.select("row", F.explode("rest").alias("r")).select("row", "r.*")
    met = rest.join(vocabulary.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    more = met.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNull(), 0).otherwise(F.col("n"))).alias("known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"),
        F.sum(F.col("n") * F.coalesce(F.log10("c"), F.col("unknown"))).alias("model"),
    )
    out = first.drop("rest").join(more.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    return out.select(*kept, "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("base_score") + F.coalesce("base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("model", F.lit(0.0))).alias("score"))


def score_documents(df: DataFrame, learn_from, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df.

    learn_from: a condition; rows that meet it train the model, the others are held out. Words are
    runs of other than ASCII white space, A-Z lower-cased; a null text has no words, and every text
    ends with one end token. Repeated rows count as often as they come; a null key is a key. Without
    training rows all words are unknown. No rows: none. Other columns do not pass.
    """
    docs = df.select(F.col(key), (~learn_from).alias("held_out"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("raw"))
    language, vocabulary = fit(docs.filter("NOT held_out"), rounds)
    scored = score(docs, language, vocabulary)
    return scored.select(key, "held_out", "n_tokens", "n_known", F.lit(language.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
