"""Operators on documents against brute force, with nulls, ties, empty and long texts, repeated rows and clashing names."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from corpuskit.llm import hmm_lm, langid, mixing, ngram_join, token_files
from corpuskit.llm._shared import new_path, split_of, tokenizer_path
from corpuskit.llm.words import Memory, slices, split

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["The", "the,", "Über", "naïve.", "<|endoftext|>", "don't", "x!!", "12", "\xa0a", "中文", "ǰ", "J̌", "Σ", "İ", "\U0001f600", "..."]


def corpus(n=160, seed=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeou") for _ in range(r.randrange(1, 6))) for _ in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.45 or not texts:
            words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 2, 3, 8, 30, 90, 200]))]
            texts.append(" ".join(words + passage * (r.random() < 0.4)))
        elif kind < 0.55:
            texts.append(r.choice(texts))
        else:
            words = r.choice(texts).split(" ")
            for _ in range(r.randrange(0, 5)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            texts.append(" ".join(words))
    rows = [(i, t, f"s{i % 4}" if i % 3 else "hot", "n") for i, t in enumerate(texts)]
    return rows + [(n, None, None, "n"), (n + 1, "", "hot", "n"), (n + 2, " \t\n", "s1", "n"), (None, "a b c d e f", "hot", "n"), (0, rows[0][1], rows[0][2], "n"), (n + 3, "word " * 20_000, "s9", "n"), (n + 4, "A" * 50_000, None, "n")]


SCHEMA = "doc_id long, text string, source string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def sets_of(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, width, percent):
    nodes = [(i, sets_of(t, width)) for i, t, *_ in rows if i is not None]
    up = {i: i for i, _ in nodes}  # rows that repeat a key are one node

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, s in nodes:
        for b, t in nodes:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


@pytest.mark.parametrize("width, percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, docs, width, percent):
    rows = corpus()
    want = brute_components(rows, width, percent)
    got = ngram_join.near_duplicates(docs, width=width, percent=percent).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.doc_id is not None) == sorted((i, len(sets_of(t, width))) for i, t, *_ in rows if i is not None)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want and [r.component_id for r in got if r.doc_id is None] == [None]


@pytest.mark.parametrize("hot", [1, 100])
def test_ngram_join_with_repeated_keys_and_hot_shingles(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocabulary) for _ in range(80)] for _ in range(3)]
    near = lambda words, n: " ".join(w if r.random() > n / len(words) else r.choice(vocabulary) for w in words)
    rows = [(3, near(base[0], 0)), (5, near(base[0], 0)), (5, near(base[1], 0)), (7, near(base[2], 0)), (9, near(base[1], 0)), (11, near(base[1], 1)), (12, near(base[2], 1)), (9, near(base[2], 2))]
    # one shingle that every text holds, and little else in common
    rows += [(100 + i, "one hot line " + " ".join(r.choice(vocabulary[: 3 + i % 5]) for _ in range(r.randrange(3, 9)))) for i in range(150)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=2, percent=70).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == brute_components(rows, 2, 70)
    assert {r.component_id for r in got if r.doc_id < 100} == {3}


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_ngram_join_of_rows_that_repeat_keys_and_sets(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", few)
    words = [f"w{i}" for i in range(60)]
    near, other = " ".join(words), " ".join(reversed(words))
    rows = [(5, near), (5, near), (5, other), (5, None), (9, near + " x"), (9, near + " x"), (7, other + " y"), (7, other + " y"), (8, "a b c d"), (8, "a b c d"), (4, near), (None, near)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(4, 4), (5, 4), (5, 5), (9, 4), (7, 4), (8, 8), (None, None)}


def test_ngram_join_shuffles_shingles_alone(spark):
    """Where no table is small enough to be broadcast by itself, whole sets are shuffled only when they are compared, and shingles with their set's row alone."""
    rng = random.Random(3)
    texts = [" ".join(str(rng.randrange(10_000)) for _ in range(600)) for _ in range(150)]
    rows = [(i, t + " end" * (i % 2)) for i, t in enumerate(t for t in texts for _ in range(2))]
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {(x := found.apply(i)).stageId(): x.shuffleWriteBytes() for found in [store.stageList(None, False, False, none, None)] for i in range(found.size())}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = stages()
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        after = stages()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {(r.doc_id, r.component_id) for r in got} == {(i, i - i % 2) for i, _ in rows}
    moved = sum(n for k, n in after.items() if k not in before) / (8 * sum(r.n_shingles for r in got))
    assert moved < 9


def test_ngram_join_without_rows(spark, docs):
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0
    one = ngram_join.first_of_each(docs)
    assert one.columns == docs.columns and one.filter("doc_id IS NULL").count() == 1


def test_token_files(spark, docs):
    lib, path = Tokenizer.from_file(PATH), new_path(spark, "tokens")
    rows = corpus() + [(1000 + i, f"{a} {b}\n{a}{b}", None, "") for i, (a, b) in enumerate(zip(ODD, ODD[::-1], strict=True))]
    token_files.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(4), path, PATH)
    got = token_files.with_crc32(token_files.read_token_files(spark, path)).orderBy("start").collect()
    assert [r.key for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    text, start = {r[0]: r[1] for r in rows}, 0
    for r in got:
        ids = lib.encode(text[r.key] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), r.key
        start += len(ids)
    assert [r.key for r in token_files.read_token_files(spark, path, 1000, 1002).orderBy("key").collect()] == [1000, 1001, 1002]
    token_files.write_token_files(docs.limit(0), empty := new_path(spark, "tokens"), PATH)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_memory_of_words_forgets_without_harm():
    own, lib = token_files.Words(PATH), Tokenizer.from_file(PATH)
    own.memory = Memory(7)
    r = random.Random(1)
    for _ in range(60):
        texts = [" ".join(r.choice(ODD + ["cat", "dog;", "Haus", "émile", "'", "'s", "a'S"]) for _ in range(r.randrange(0, 14))) for _ in range(3)]
        at, ids = own.encode(pa.array([*texts, None]))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [lib.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_words_equal_pythons():
    r = random.Random(1)
    texts = ["".join(r.choice(["a", "B", "é", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "中"]) for _ in range(r.randrange(0, 12))) for _ in range(3000)] + [None, "", "x" * 100_000]
    raw = [(t or "").encode() for t in texts]
    for column in (pa.array(texts), pa.array(texts).slice(5, 300), pa.array(raw), pa.array([], pa.string()), pa.array([None, ""])):
        for lower in (False, True):
            starts, codes, found = split(column, lower)
            want = [(x if isinstance(x, bytes) else (x or "").encode()) for x in column.to_pylist()]
            words = found.to_pylist()
            assert [[words[k] for k in codes[a:b]] for a, b in zip(starts, starts[1:], strict=False)] == [(x.lower() if lower else x).split() for x in want]
    runs = list(slices(pa.array(["a" * 10, "b" * 30, None, "c"] * 3), 25))
    assert [low for low, _ in runs] == [sum(n for _, n in runs[:i]) for i in range(len(runs))] and sum(n for _, n in runs) == 12


def test_layout_of_token_files(spark):
    path = new_path(spark, "tokens")
    rows = [(i, " ".join(f"w{i * j % 977}" for j in range(60))) for i in range(3000)]
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), path, PATH, row_group_bytes=200_000, page_bytes=8 << 10, page_rows=100)
    folder = path.removeprefix("file://")
    files = [pq.ParquetFile(os.path.join(folder, f)) for f in sorted(os.listdir(folder)) if f.endswith(".parquet")]
    assert sum(f.metadata.num_rows for f in files) == 3000 and max(f.metadata.num_row_groups for f in files) > 1
    for f in files:
        for g in range(f.metadata.num_row_groups):
            column = {f.metadata.row_group(g).column(c).path_in_schema: f.metadata.row_group(g).column(c) for c in range(f.metadata.num_columns)}
            ids = next(v for k, v in column.items() if k.startswith("ids"))
            assert ids.has_dictionary_page or any("DELTA" in e for e in ids.encodings)
            assert column["key"].has_offset_index and column["key"].has_column_index
    plan = token_files.read_token_files(spark, path, 10, 12)._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key,10)" in plan
    with pytest.raises(ValueError, match="white space"):
        token_files.Words(tokenizer_path("byte_bpe_50k.json"))


def test_targets():
    assert mixing.targets([]) == []
    for sizes in ([("a", 10)], [("a", 0)], [("a", 0), (None, 0)], [("b", 5), ("a", 100), (None, 50), ("c", 7)], [(f"s{i}", i * i) for i in range(30)]):
        got = dict(mixing.targets(sizes))
        total = sum(n for _, n in sizes)
        assert abs(sum(got.values()) - 1.5 * total) < 1e-6
        unit = [got[s] / w for (s, n), w in zip(sorted(sizes, key=lambda x: (x[0] is None, x[0] or "")), [5, 2, 1] * 20, strict=False) if got[s] < 2 * n - 1e-9]
        assert all(got[s] <= 2 * n + 1e-9 for s, n in sizes) and (not unit or max(unit) - min(unit) < 1e-6 * max(unit))


def test_mixing(spark, docs):
    rows = corpus()
    got = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    assert sorted((r.key is None, r.key, r.size, r.source or "") for r in got if r.key is not None) == sorted((i is None, i, size(t), s or "") for i, t, s, _ in rows if i is not None)
    for s in {r[2] for r in rows}:
        mine = [r for r in got if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target) and mine[0].source_size == sum(r.size for r in mine)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.limit(0)).count() == 0
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.exceptAll(docs.unionAll(docs)).count() == 0


def test_language(spark):
    r = random.Random(2)
    words = {"xx": ["schön", "über", "haus", "und", "ein"], "yy": ["the", "house", "and", "nice", "of"], "zz": ["être", "maison", "et", "dans", "où"]}
    rows = [(i, " ".join(r.choice(words[l]) + r.choice(["", "s", "n"]) for _ in range(r.randrange(4, 40))), l) for i in range(240) for l in [r.choice(list(words))]]
    df = spark.createDataFrame(rows + [(900, None, "xx"), (901, "12 !? ...", "yy"), (902, "", None), (None, "the house", None), (1, rows[1][1], "xx"), (903, "the " * 30_000, None), (904, "½ ² ① Ⅷ", None)], "doc_id long, text string, lang string")
    fold = split_of(__import__("pyspark").sql.functions.col("doc_id"), 4)
    model = langid.train(df.filter(fold != 2))
    got = langid.identify(df.withColumnRenamed("lang", "score"), model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score", "ambiguous"]
    found = {x.doc_id: x for x in got.collect()}
    held = [(i, l) for i, _, l in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and np.mean([found[i].lang_pred == l for i, l in held]) > 0.97
    assert {i for i, x in found.items() if x.lang_pred == "und"} == {900, 901, 902, 904} and found[903].lang_pred == found[None].lang_pred == "yy"
    assert all(0 <= x.score <= 1 for x in found.values())
    # half and half is flagged and scores low, one language is not
    say = lambda *ls: " ".join(r.choice(words[l]) + r.choice(["", "s", "n"]) for l in ls for _ in range(60 // len(ls)))
    mixed = [(0, say("xx", "yy")), (0, say("zz", "yy")), (0, say("xx", "zz")), *((1, say(l)) for l in words for _ in range(3))]
    flags = langid.identify(spark.createDataFrame(mixed, "pure int, text string"), model).collect()
    assert all(x.ambiguous == (not x.pure) for x in flags) and max(x.score for x in flags if not x.pure) < min(x.score for x in flags if x.pure)
    # equal shares go to the smaller name
    even = langid.Model(["aa", "bb"], np.zeros((langid.BINS, 1)), langid.codewords(2))
    assert [x.lang_pred for x in langid.identify(spark.createDataFrame([("word",)], "text string"), even).collect()] == ["aa"]
    assert langid.train(df.limit(0)) is None and langid.identify(df, None).filter("lang_pred <> 'und'").count() == 0
    code = langid.codewords(30)
    assert min((code[i] != code[j]).sum() for i in range(30) for j in range(i)) >= 10


def test_language_model(spark, docs):
    F = __import__("pyspark").sql.functions
    rows = corpus()
    got = hmm_lm.score_documents(docs, split_of(F.col("doc_id"), 7) != 2).collect()
    words = lambda t: (t or "").encode().lower().split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = {i: (held(i), len(words(t)) + 1, sum(w in counts for w in [*words(t), None]), n, sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4] and abs(r.base_score - want[r.doc_id][4]) < 1e-6 * r.n_tokens and r.score < 0
    assert hmm_lm.score_documents(docs.limit(0), F.col("doc_id") > 0).count() == 0
    assert all(r.n_known == 0 for r in hmm_lm.score_documents(docs.limit(5), F.lit(False)).collect())


def test_scores_against_all_paths(spark, monkeypatch):
    monkeypatch.setattr(hmm_lm, "HEAD", 3)
    monkeypatch.setattr(hmm_lm, "LOOKUP", 6)
    monkeypatch.setattr(hmm_lm, "STATES", 2)
    r = random.Random(6)
    texts = [" ".join(r.choice("aa bb cc dd ee ff gg hh Hh ii jjjj".split()) for _ in range(r.randrange(0, 7))) for _ in range(60)] + ["zz qq", "new words", None]
    docs = spark.createDataFrame([(i, (t or "").encode(), i >= 50) for i, t in enumerate(texts)], "doc_id long, raw binary, held_out boolean").repartition(3)
    language, vocabulary = hmm_lm.fit(docs.filter("NOT held_out"))
    assert len(language.lookup) <= 6 and len(language.classes) == 3  # no cliff at a step of counts
    counts = Counter(w for t in texts[:50] for w in t.lower().split())
    model, first = language.model, 3
    emit = model.emit * 10**model.most

    def word(w, state):
        w = w.encode()
        if w in language.classes:
            return emit[state, language.classes[w]]
        k, c = hmm_lm.tail_class(w), counts[w.decode()]
        return emit[state, first + k] * (c or language.novel[k]) / (language.sums[k] + language.unknown[k])

    for row in hmm_lm.score(docs, language, vocabulary).collect():
        words = (texts[row.doc_id] or "").lower().split()
        total = 0.0
        for path in np.ndindex(*[2] * (len(words) + 1)):
            p = model.first[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += p * np.prod([word(w, z) for w, z in zip(words, path, strict=False)]) * emit[path[-1], language.classes.end]
        assert abs(np.log10(total) - row.score) < 1e-9, texts[row.doc_id]
    # what a class leaves to unknown words is not more than the estimated number of them can have
    assert (language.novel <= language.unknown + 1e-12).all() and (language.novel[language.sums > 20] < 1.5).all()


def test_states_start_from_all_documents(spark):
    # long texts, and copies of one text that come first in order
    r = random.Random(4)
    texts = [" ".join(f"{k}{r.randrange(40)}" for _ in range(4000)) for k in ("rain", "zinc") for _ in range(40)] + ["aaaa bbbb " * 14] * 2000
    docs = spark.createDataFrame([(t.encode(),) for t in texts], "raw binary").repartition(3)
    language, _ = hmm_lm.fit(docs, rounds=0)
    share = lambda name: language.model.emit[:, [k for w, k in language.classes.items() if w.startswith(name)]].sum(1)
    for name in (b"rain", b"zinc", b"aaaa"):
        assert share(name).max() > 100 * share(name).min()
    assert len({int(share(name).argmax()) for name in (b"rain", b"zinc", b"aaaa")}) == 3


def test_recursions_against_all_paths():
    r = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.Model(norm(r.random(3)), norm(r.random((3, 3))), norm(r.random((3, 5))))
    sequences = [r.integers(0, 5, k) for k in (4, 1, 3, 4)]
    got = hmm_lm.Batch(sequences).log10(model)
    counts = hmm_lm.Counts(3, 5)
    hmm_lm.Batch(sequences).expect(model, counts)
    rough = hmm_lm.Counts(3, 5)
    hmm_lm.Batch(sequences).expect(model.single(), rough)
    assert np.allclose(rough.emit, counts.emit, rtol=1e-4) and np.allclose(rough.move, counts.move, rtol=1e-4) and abs(rough.value - got.sum()) < 1e-4 and abs(counts.value - got.sum()) < 1e-9
    chances = model.emit * 10**model.most
    move, emit = np.zeros((3, 3)), np.zeros((3, 5))
    for s, value in zip(sequences, got, strict=True):
        paths = {}
        for path in np.ndindex(*[3] * len(s)):
            p = model.first[path[0]] * np.prod([chances[z, x] for z, x in zip(path, s, strict=True)]) * np.prod([model.move[a, b] for a, b in zip(path, path[1:], strict=False)])
            paths[path] = p
        total = sum(paths.values())
        assert abs(np.log10(total) - value) < 1e-9
        for path, p in paths.items():
            for z, x in zip(path, s, strict=True):
                emit[z, x] += p / total
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p / total
    assert np.allclose(emit, counts.emit) and np.allclose(move, counts.move)


def test_pipeline_keeps_texts_with_letters(spark, monkeypatch):
    import corpus_pipeline as cp

    F = __import__("pyspark").sql.functions
    rows = [(i, t, None, "s", 0) for i, t in enumerate(["the house und das Haus " * 8, "ein Haus", "12 !?", "", None])]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.language(spark, at, "").collect()} == {0, 1}
    between = lambda df, model: df.withColumn("lang_pred", F.when(F.col("text").rlike("[a-z]"), "en").otherwise("und")).withColumn("ambiguous", F.lit(True))
    monkeypatch.setattr(cp, "identify", between)
    monkeypatch.setattr(cp, "train", lambda df: "a model")
    assert {r.doc_id for r in cp.language(spark, at, "").collect()} == {0, 1}


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    F = __import__("pyspark").sql.functions
    rows = [(i, t, "en", s, 0) for i, t, s, _ in corpus()]
    at = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = cp.language(spark, at, "")
    assert set(first.columns) == set(cp.COLUMNS)
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(map(str, (tuple(r) for r in first.select("doc_id", "text", "lang", "source", "n_chars").collect()))) == sorted(map(str, kept))
    second = cp.near_duplicates(spark, first, "")
    want = brute_components(kept, 5, 80)
    assert {r.doc_id for r in second.collect() if r.doc_id is not None} == {i for i, c in want.items() if i == c}
    third = cp.mixing(spark, second, "")
    assert third.count() and third.join(second, "doc_id", "left_anti").filter(F.col("doc_id").isNotNull()).count() == 0
    last = cp.tokens(spark, third, "")
    assert last.columns == ["doc_id", "source", "ids", "n_tokens"] and last.count() == third.count()
