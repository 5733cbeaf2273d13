import numpy as np
import pytest

from corpuskit import registry
from corpuskit.operators.collection import Collection, compile_filter, nearest_batch, updated
from corpuskit.operators.embedding import HashingEmbedder, encode

BOATS = [
    {"id": "tern", "content": "a dinghy", "embedding": [3.0, 0.0, 4.0], "metadata": {"hull": "wood", "built": 1971}},
    {"id": "skua", "content": "a ketch", "embedding": [0.0, 2.0, 0.0], "metadata": {"hull": "steel", "built": 2004}},
    {"id": "gannet", "embedding": [6.0, 0.0, 8.0], "metadata": {"hull": "steel", "built": "unknown"}},
    {"id": "auk", "content": "a raft", "embedding": [0.0, 0.0, 0.0], "metadata": None},
]
NORTH = [0.0, 1.0, 0.0]


def test_life_of_a_collection(spark, tmp_path):
    c = Collection(spark, "boats", str(tmp_path))
    assert c.count() == 0 and c.query(NORTH).count() == 0
    c.add(BOATS)
    c.add([BOATS[1] | {"content": "another"}, {"id": 12, "embedding": [1, 1, 1]}])
    assert c.count() == 5 and c.get("skua")["content"] == "a ketch" and c.get("gannet")["content"] == "" and c.get(12)["metadata"] is None and c.get("puffin") is None
    got = [(r.id, r.score) for r in c.query(NORTH, top_k=5).collect()]
    # equal distances by id, no direction last
    assert [i for i, _ in got] == ["skua", "12", "gannet", "tern", "auk"] and got[0][1] == pytest.approx(0) and got[-1][1] is None
    steel = {r.id for r in c.query(NORTH, {"hull": "steel"}).collect()}
    assert steel == {"skua", "gannet"} and c.query(NORTH, {"hull": "glass"}).count() == 0
    # numbers as numbers, also beside values that are none
    assert [r.id for r in c.query(NORTH, {"built": {"$gt": 1990}}).collect()] == ["skua"]
    assert [r.id for r in c.query(NORTH, {"$or": [{"built": 1971}, {"built": {"$in": [2004, 5]}}]}).collect()] == ["skua", "tern"]
    c.update({"id": "tern", "embedding": [0, 5, 0], "metadata": {"hull": "cedar"}})
    assert c.get("tern") == {"id": "tern", "content": "a dinghy", "metadata": {"built": "1971", "hull": "cedar"}, "score": None}
    assert [tuple(r.embedding) for r in c.rows().filter("id = 'tern'").collect()] == [(0, 5, 0)]
    c.delete(["auk", "puffin"])
    c.delete([])
    assert Collection(spark, "boats", str(tmp_path)).count() == 4 and Collection(spark, "cars", str(tmp_path)).count() == 0
    c.clear()
    c.clear()
    assert c.count() == 0


def test_nearest_of_many(spark):
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0]), ("d", [1.0]), ("e", [None, 1.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [2.0, 0.1]), ("r", None), ("s", [3.0])], "query_id string, query_vector array<double>")
    assert sorted((r.query_id, r.id, r["rank"]) for r in nearest_batch(docs, asked, 3).collect()) == [("q", "a", 1), ("q", "c", 2), ("s", "d", 1)]


def test_changes_of_one_id_leave_one_row(spark):
    schema = "id string, content string, embedding array<float>, metadata map<string, string>"
    now = spark.createDataFrame([("x", "old", [1.0], None)], schema)
    change = spark.createDataFrame([("x", "new", [2.0], None), ("x", "new", [2.0], None)], schema)
    assert [(r.content, r.embedding) for r in updated(now, change).collect()] == [("new", [2.0])]


def test_refusals(spark, tmp_path):
    c = Collection(spark, "boats", str(tmp_path))
    for bad in ([], [{"embedding": [1.0]}], [BOATS[0], {"id": "x"}]):
        with pytest.raises(RuntimeError):
            c.add(bad)
    assert c.count() == 0
    with pytest.raises(ValueError):
        c.update({"id": "tern", "embedding": [1.0]})
    with pytest.raises(ValueError):
        c.update({"id": "tern"})
    with pytest.raises(ValueError):
        compile_filter({"a": {"$like": 1}}, lambda k: None)
    with pytest.raises(ValueError, match="known"):
        registry.get_provider("nothing")


def test_embedding(spark):
    e = HashingEmbedder(16)
    assert e.encode("x").shape == (1, 16) and e.encode(["a b", "c", ""], 2).dtype == np.float32
    assert np.allclose(np.linalg.norm(e.encode(["a b", "c d e"], normalize=True), axis=1), 1)
    with pytest.raises(ValueError):
        e.encode([])
    df = spark.createDataFrame([("a b",), (None,), ("a b",)], "text string")
    rows = [r.embedding for r in encode(df, e).collect()]
    assert rows[1] is None and rows[0] == rows[2] == e.encode("a b")[0].tolist()
