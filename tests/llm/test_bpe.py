import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpuskit.llm._shared import tokenizer_path
from corpuskit.llm.bpe import Codec, bpe, codec, decode
from corpuskit.llm.words import Memory

PATH = tokenizer_path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
PARTS = ["the", "ing", " ", "  ", "\n", " \n", "\t", "é", "中", "\U0001f600", "'s", "'LL", "<|endoftext|>", "<|end", "123", "\xa0", "\x1c", "\x85", "́", "�", "\x00", "...", "　", "ſ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=25).map("".join))
def test_equals_library(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = LIB.encode(text, add_special_tokens=False).ids
    own = codec(PATH).encode(text)
    assert np.frombuffer(own, "<u4").tolist() == ids
    assert codec(PATH).decode(own).decode() == LIB.decode(ids, skip_special_tokens=False)
    starts, packed = codec(PATH).encode_all(pa.array(["a b", text, None, text + " x"]))
    assert np.frombuffer(packed, "<u4")[starts[1] : starts[2]].tolist() == ids and starts[2] == starts[3]
    assert [x.decode() for x in codec(PATH).decode_all(starts, packed)] == [LIB.decode(LIB.encode(t, add_special_tokens=False).ids, skip_special_tokens=False) for t in ("a b", text, "", text + " x")]


def test_memory_forgets_without_harm():
    own = Codec(PATH)
    own.memory = Memory(5)
    r = random.Random(3)
    for _ in range(40):
        texts = ["".join(r.choice([*PARTS, "Don't", "Über", " Über", "x,y", ",", " ,"]) for _ in range(9)) for _ in range(4)]
        starts, packed = own.encode_all(pa.array(texts))
        assert np.frombuffer(packed, "<u4").tolist() == [i for t in texts for i in LIB.encode(t, add_special_tokens=False).ids]


def test_long_word_is_linear():
    for text in ("a" * 60_000, "ab" * 30_000, " " * 50_000 + "x"):
        assert np.frombuffer(codec(PATH).encode(text), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text():
    ids = LIB.encode("é", add_special_tokens=False).ids + LIB.encode("中", add_special_tokens=False).ids[:1]
    assert codec(PATH).decode(np.array(ids, "<u4").tobytes()).decode() == LIB.decode(ids)


def test_frames(spark):
    rows = [(1, "The cat.", "x"), (1, "The cat.", "x"), (None, None, None), (3, "", "y"), (4, "word " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe(df, PATH, outputs=("ids", "n_tokens", "decoded", "ids_sha256", "decoded_sha256"))
    got = sorted(out.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.n_tokens for r in got] == [len(LIB.encode(r.text or "", add_special_tokens=False).ids) for r in got]
    for r in got:
        assert r.decoded == (r.text or "") and r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert decode(out.select("ids"), PATH).filter("text = 'The cat.'").count() == 2
    assert bpe(df.limit(0), PATH).count() == 0
