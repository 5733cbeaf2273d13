import numpy as np
import pytest

from corpuskit.llm.components import components
from corpuskit.llm.top_k import Lists, top_k
from corpuskit.llm.vectors_near import linked, near_vectors

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def vectors(n=260, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dim))
    rows = [(i, (centres[r.integers(30)] * r.uniform(0.5, 2) + r.normal(size=dim) * 0.25).astype(np.float32).tolist(), int(r.integers(3))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [NAN] + [1.0] * (dim - 1), 1), (n + 3, [INF] * dim, 1), (n + 4, [None] + [1.0] * (dim - 1), 1), (n + 5, [], 1), (n + 6, rows[0][1], None), (n + 7, rows[0][1], rows[0][2]), (n + 8, [1.0, 2.0], 1), (3, rows[3][1], rows[3][2])]
    return [(*row, "x") for row in rows]


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def brute_links(rows):
    """(vec_id, links, smallest id reachable) of every row; rows that repeat an id are vectors of their own."""
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    real = {k: np.array(v, float) for k, (i, v, l, *_) in enumerate(rows) if i is not None and good(v) and l is not None and any(v)}
    links = {k: {j for j in real if j != k and rows[k][2] == rows[j][2] and len(real[k]) == len(real[j]) and cos(real[k], real[j]) >= 0.93} if k in real else set() for k in range(len(rows))}
    label = [r[0] for r in rows]
    for _ in rows:
        label = [min([label[k], *(label[j] for j in links[k])]) if links[k] else label[k] for k in range(len(rows))]
    return [(r[0], len(links[k]), label[k], r[0] is not None and label[k] == r[0]) for k, r in enumerate(rows)], links


def test_near_vectors(spark):
    rows = vectors()
    # one id with three vectors, two of which link other groups
    rows += [(9000, rows[0][1], rows[0][2], "x"), (9000, rows[1][1], rows[1][2], "x"), (9000, [-x for x in rows[0][1]], rows[0][2], "x"), (None, [1.0] * 8, 1, "x")]
    want, links = brute_links(rows)
    for block in (16, 1024):
        got = near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(map(len, links.values())) > 100
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lengths_beyond_the_range_of_squares(spark):
    rows = [(1, [1e160, 2e160], 1), (2, [1e-170, 2e-170], 1), (3, [1.0, 2.0], 1), (4, [1.0, -2.0], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_bounds_hold():
    r = np.random.default_rng(3)
    for scale in (1e-20, 1.0, 1e20):
        x = r.normal(size=(300, 64)) * scale
        y = x[r.permutation(300)] + r.normal(size=(300, 64)) * scale * 0.38
        want = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None]) >= 0.93
        found = np.zeros_like(want)
        for i, j in linked(x, y, 0.93):
            found[i, j] = True
        assert 20 < want.sum() < 280 and (found == want).all()


def brute(rows, k, every, scale):
    one = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v, *_ in rows if i is not None and good(v)]
    out = []
    for at, (q, x) in enumerate(one):
        if q % every == 0:
            scored = sorted((-int(x @ y), i) for j, (i, y) in enumerate(one) if j != at and len(x) == len(y))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1, 256])
def test_top_k(spark, scale):
    rows = vectors()
    rows += [(40, [-x for x in rows[40][1]], 0, "x"), (7, rows[9][1], 0, "x"), (40, rows[40][1], 0, "x")]
    df = spark.createDataFrame([*rows, (None, [1.0] * 8, 1, "x")], SCHEMA)
    got = top_k(df, every=20, scale=scale, block=40, chunk=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 20, scale)
    assert top_k(df.limit(0)).count() == 0


def test_lists_stop_early_and_right():
    r = np.random.default_rng(2)
    rows = r.integers(-300, 300, (3000, 4))
    lists = Lists(np.arange(3000) * 3, rows)
    for q in (np.array([5, 0, 0, 0]), np.array([0, 0, 0, 0]), r.integers(-300, 300, 4), r.integers(-3, 3, 4)):
        ids, scores = lists.search(9, q, 5)
        want = sorted((-int(rows[i] @ q), i * 3) for i in range(3000) if i != 3)[:5]
        assert list(zip((-scores).tolist(), ids.tolist(), strict=True)) == want
    lists.scored = 0
    lists.search(9, np.array([5, 1, 0, 0]), 5)
    assert lists.scored < 1500  # the bound ends the reading


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, i) for i in range(200, 260)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (3, None), (160, 100), (1, 160)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 1 for i in [1, *range(100, 161)]}, **{i: 5 for i in [5, *range(200, 260)]}, 7: 7}
    assert components(edges.limit(0)).count() == 0
