"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier over hashed byte n-grams
tells the languages whose word has a 1 there from those with a 0; loss-weighted decoding picks the
codeword whose bits cost least under the logistic loss of the classifiers' margins. Several
classifiers have to err before another language is nearest.

A text in two languages has margins between those of either, so it lies less far ahead of the second
nearest codeword than texts of its language usually do. How far they usually do is measured, like the
scale of the margins, on labelled rows that the classifiers were not fitted to.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm._shared import in_arrow
from corpuskit.llm.words import listed, slices, split

BINS, ORDERS = 1 << 16, (1, 2, 3, 4)
#: About so many labelled documents of each language train the classifiers (all, if fewer): the bound on the sample.
PER_LANGUAGE = 2_000
#: The share of the sample that is held back from the fit, for the scale of the margins and the usual lead.
HELD_BACK = 0.2
#: Distinct words whose n-grams are taken together.
WORDS = 20_000
UNDETERMINED = "und"
LETTER = r"\p{L}"


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to 5 languages: every way to part them in two. More: random columns, of 64 draws the one whose rows lie farthest apart."""
    if n <= 5:
        columns = [c for c in itertools.product((1, -1), repeat=max(n, 1)) if c[0] == 1 and (len(set(c)) > 1 or n < 2)]
        return np.array(columns, float).T[:n]
    draw, best, apart = np.random.default_rng(7), None, -1.0
    width = int(np.ceil(10 * np.log2(n)))
    for _ in range(64):
        code = draw.choice([1.0, -1.0], size=(n, width))
        distance = (width - code @ code.T) / 2 + width * np.eye(n)
        least = distance.min() - (np.abs(code.sum(0)) == n).sum()
        if least > apart:
            best, apart = code, least
    return best


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all n-grams of the words, each with a space at either end, and the words they are of."""
    joined = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    space = joined == 32
    word = np.cumsum(space, dtype=np.int32) - 1
    last = np.append(np.nonzero(space)[0], len(joined)).astype(np.int32)
    ahead = last[np.minimum(word + 1, len(last) - 1)]  # the next space
    bins, of = [], []
    rolled = np.zeros(len(joined), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        rolled = rolled[: len(joined) - n + 1] * np.uint32(0x01000193) ^ joined[n - 1 :]
        if n in ORDERS:
            start = np.arange(len(rolled), dtype=np.int32)
            fits = (start + (n - 1) <= ahead[: len(rolled)]) & (word[: len(rolled)] < len(words))
            if n == 1:
                fits &= ~space
            mixed = (rolled[fits] + np.uint32(n)) * np.uint32(0x9E3779B1)
            bins.append((mixed >> np.uint32(16)).astype(np.uint16))
            of.append(word[: len(rolled)][fits])
    return np.concatenate(bins), np.concatenate(of)


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(texts, ""))


def sums(texts: pa.Array, weights: np.ndarray) -> np.ndarray:
    """For each text the sums of its n-grams' rows of weights, and in a last column how many n-grams it has."""
    starts, codes, found = split(lowered(texts))
    words = listed(found)
    rows = np.empty((len(words), weights.shape[1] + 1), np.float32)
    for low in range(0, len(words), WORDS):
        some = words[low : low + WORDS]
        bins, of = grams(some)
        for c in range(weights.shape[1]):
            rows[low : low + WORDS, c] = np.bincount(of, weights[bins, c], len(some))
        rows[low : low + WORDS, -1] = np.bincount(of, minlength=len(some))
    out, some = np.zeros((len(texts), rows.shape[1])), np.nonzero(np.diff(starts))[0]
    if len(some):
        for c in range(rows.shape[1]):
            out[some, c] = np.add.reduceat(rows[codes, c], starts[some], dtype=np.float64)
    return out


class Model:
    """languages, their codewords, the weights of each bit's classifier, the scale of the margins, and the usual lead of each language."""

    def __init__(self, languages: list[str], weights: np.ndarray, code: np.ndarray, scale: float = 1.0, lead: np.ndarray | None = None):
        self.languages, self.weights, self.code, self.scale = languages, weights.astype(np.float32), code, scale
        self.lead = np.zeros(len(languages)) if lead is None else lead

    def margins(self, sums: np.ndarray) -> np.ndarray:
        """Of each text and bit, the mean over its n-grams."""
        return sums[:, :-1] / np.maximum(sums[:, -1:], 1)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        cost = np.logaddexp(0, -self.scale * margins[:, None, :] * self.code[None]).sum(2)
        p = np.exp(cost.min(1, keepdims=True) - cost)
        return p / p.sum(1, keepdims=True)

    def ahead(self, margins: np.ndarray, best: np.ndarray) -> np.ndarray:
        """How far each text's margins agree better with its best codeword than with any other, in margins a bit."""
        agree = margins @ self.code.T
        own = agree[np.arange(len(best)), best].copy()
        agree[np.arange(len(best)), best] = -np.inf
        return (own - agree.max(1)) / self.code.shape[1] if self.code.shape[0] > 1 else own * 0

    def decided(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, lead): the nearest codeword, its share of the weights, less where the lead is less than usual; and the lead as a share of the usual one."""
        margins = self.margins(sums)
        p = self.probabilities(margins)
        best = p.argmax(1)
        usual = self.lead[best]
        lead = np.where(usual > 0, self.ahead(margins, best) / np.where(usual > 0, usual, 1), 1.0)
        return best, p[np.arange(len(best)), best] * np.clip(lead, 0, 1), lead


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of the languages in df; None without a labelled text.

    Rows with a null text or language do not count. The sample is every row whose key and text hash
    below its language's share, about per_language rows each; a fifth of it is held back from the fit
    for the scale and the usual leads (all of it is used for both if a language has fewer than 20
    rows). Executors count n-grams of whole texts; the driver gets, from each of 16 tasks in turn, one
    histogram for each language, and the margins of the rows held back.
    """
    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = sorted((l, n) for l, n in rows.groupBy(F.col(lang).cast("string")).count().collect())
    if not counts:
        return None
    languages = [l for l, _ in counts]
    share = F.create_map(*(F.lit(x) for l, n in counts for x in (l, min(1.0, per_language / n))))
    drawn = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(drawn(0) < F.element_at(share, F.col(lang).cast("string")))
    back = F.lit(True) if min(n for _, n in counts) < 20 else drawn(1) < HELD_BACK
    sample = sample.select(F.col(lang).cast("string").alias("lang"), back.alias("back"), F.col(text).alias("text")).repartition(16)  # bounded
    fitted = sample if min(n for _, n in counts) < 20 else sample.filter("NOT back")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for batch in batches:
            for low, n in slices(batch.column("text")):
                piece = batch.slice(low, n)
                starts, codes, words = split(lowered(piece.column("text")))
                words, langs = listed(words), np.array(piece.column("lang").to_pylist(), object)
                of_text = np.repeat(np.arange(n), np.diff(starts))
                for l in set(langs):
                    times = np.bincount(codes[langs[of_text] == l], minlength=len(words))
                    for first in range(0, len(words), WORDS):
                        bins, of = grams(words[first : first + WORDS])
                        found[l] = found.get(l, 0) + np.bincount(bins, times[first : first + WORDS][of], BINS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([x.astype("<f8").tobytes() for x in found.values()], pa.binary())], names=["lang", "bins"])

    histogram = {l: np.zeros(BINS) for l in languages}
    for row in in_arrow(fitted.select("lang", "text"), count, "lang string, bins binary").toLocalIterator():
        histogram[row["lang"]] += np.frombuffer(row["bins"], "<f8")
    code = codewords(len(languages))
    smooth = np.array([(h + 0.5) / (h.sum() + 0.5 * BINS) for h in histogram.values()])
    weights = np.zeros((BINS, code.shape[1]))
    for b in range(code.shape[1]):
        yes, no = smooth[code[:, b] > 0], smooth[code[:, b] < 0]
        if len(yes) and len(no):
            weights[:, b] = np.log(yes.mean(0)) - np.log(no.mean(0))
    model = Model(languages, weights, code)
    if len(languages) > 1:
        shared = df.sparkSession.sparkContext.broadcast(model)

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, n in slices(batch.column("text")):
                    piece = batch.slice(low, n)
                    yield pa.RecordBatch.from_arrays([piece.column("lang"), pa.array(list(sums(piece.column("text"), shared.value.weights)), pa.list_(pa.float64()))], names=["lang", "sums"])

        seen = in_arrow(sample.filter("back").select("lang", "text"), added, "lang string, sums array<double>").collect()
        calibrate(model, np.array([r["sums"] for r in seen]).reshape(len(seen), -1), np.array([languages.index(r["lang"]) for r in seen], int))
        shared.unpersist()
    return model


def calibrate(model: Model, sums: np.ndarray, right: np.ndarray) -> None:
    """Set the scale under which the right languages are likeliest, and each language's usual lead: the median over its texts."""
    if not len(right):
        return
    margins, likelihood = model.margins(sums), {}
    for scale in (1, 2, 4, 8, 16, 32, 64):
        model.scale = float(scale)
        likelihood[scale] = np.log(np.maximum(model.probabilities(margins)[np.arange(len(right)), right], 1e-6)).mean()
    model.scale = float(max(likelihood, key=likelihood.get))
    lead = model.ahead(margins, right)
    model.lead = np.array([max(np.median(lead[right == k]), 0) if (right == k).any() else 0 for k in range(len(model.languages))])


def identify(df: DataFrame, model: Model | None, text: str = "text", ambiguous_below: float = 0.4) -> DataFrame:
    """df with lang_pred, score and ambiguous, one row for a row; columns of those names are replaced.

    score, from 0 to 1, is the language's share among the codewords' weights, reduced where the text
    lies less far ahead of the second nearest codeword than its language usually does; ambiguous: it
    lies ahead by less than ambiguous_below of the usual lead, as texts do that are in two languages.
    A null text, or one without a letter (a character of Unicode's L categories), is `und` with score
    0, as is every text without a model. Texts are read whole, a few megabytes or one longer text at a
    time; equal shares go to the smaller language name. No shuffle.
    """
    new = ("lang_pred", "score", "ambiguous")
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    source, at = df.select(*kept), kept.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, n in slices(batch.column(at)):
                piece = batch.slice(low, n)
                lang, score, ambiguous = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
                texts = pc.fill_null(piece.column(at), "")
                letters = pc.match_substring_regex(texts, LETTER).to_numpy(zero_copy_only=False)
                if own and letters.any():
                    best, p, lead = own.decided(sums(texts, own.weights))
                    lang[letters] = np.array(own.languages, object)[best[letters]]
                    score[letters], ambiguous[letters] = p[letters], lead[letters] < ambiguous_below
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=schema.names)

    return in_arrow(source, run, schema)
