"""Operator 7: recall against brute force, exact scores and order, and its edge cases."""

from collections import defaultdict

import numpy as np

from florilege.llm import kmtree

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, v string"


def brute(rows, k=20):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    return {q: sorted(((-float(np.dot(good[q], good[i])), i) for i in good if i != q))[:k] for q in good if q % 20 == 0}


def run(spark, rows, **kw):
    got = defaultdict(list)
    for r in kmtree.search(spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], SCHEMA), **kw).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def recall(got, want):
    hit = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q]}) for q in want)
    return hit / sum(map(len, want.values()))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 24)) * 2
    rows = [(i, (centres[i % 30] * rng.uniform(0.5, 2) + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(6000)]
    got, want = run(spark, rows, sample=3000, leaf_size=60), brute(rows)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, x in got.items():
        assert [r for r, _, _ in x] == list(range(1, 21))
        assert all(abs(s - float(vectors[q] @ vectors[i])) < 1e-9 for _, i, s in x)
        assert [(-s, i) for _, i, s in x] == sorted((-s, i) for _, i, s in x)


def test_ties_copies_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100)] + [(100 + i, [float(i % 3), 1.0]) for i in range(60)]
    rows += [(500, None), (520, []), (540, [0.0, 0.0]), (560, [None, 1.0]), (580, [float("nan"), 1.0]), (600, [float("inf"), 1.0]), (620, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (20, [1.0, 2.0])]
    got = run(spark, rows)
    want = brute([r for r in rows[:160]])
    assert {q: [(i, -s) for s, i in x] for q, x in want.items()} == {q: [(i, s) for _, i, s in x] for q, x in got.items()}


def test_few_and_none(spark):
    assert run(spark, []) == {}
    assert run(spark, [(1, [1.0])]) == {}
    assert run(spark, [(0, [1.0]), (3, [2.0])]) == {0: [(1, 3, 2.0)]}


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = defaultdict(list)
    for r in kmtree.search(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert recall(got, brute(rows)) >= 0.9
