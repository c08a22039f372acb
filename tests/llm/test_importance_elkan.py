"""Importance resampling and exact centroid clustering against brute force."""

import hashlib
import math
import random
from zlib import crc32

import numpy as np
import pytest

from florilege.llm import elkan, importance


def test_composed_crcs_are_those_of_the_strings():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcé9") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 31, 300]))).encode() for _ in range(200)] + [b"x" * 70_000, b"y"]
    for ngrams in ((1, 1), (1, 3), (2, 4)):
        got = sorted(int(c) for part in importance.feature_crcs(words, ngrams) for c in part)
        want = sorted(crc32(b" ".join(words[i : i + n])) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(words) - n + 1))
        assert got == want
    assert [list(c) for c in importance.feature_crcs([b"only"], (2, 3))] == []


def test_runs_over_the_edge_of_a_block(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 7)
    words = [str(i).encode() for i in range(40)]
    got = sorted(int(c) for part in importance.feature_crcs(words, (1, 3)) for c in part)
    assert got == sorted(crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1))


def drawn_by_force(docs, target, ngrams, least, share, buckets, seed="2024"):
    feats = lambda t: (lambda w: [b" ".join(w[i : i + n]) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1)])(importance.words_of(t))
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in feats(x):
                counts[crc32(f) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        f = feats(x)
        weight = sum(gain[crc32(g) % buckets] for g in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(importance.words_of(x))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * share // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2)])
def test_resample_against_brute_force(spark, ngrams):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["Café", "É", "ß", "ЯК", "語"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 30))) for i in range(300)] + [(7, text(25)), (None, text(25)), (None, None), (900, None), (901, ""), (902, "  .,; "), (903, "z" * 100_000 + " a" * 50)]
    docs += [(1000 + i, docs[3][1]) for i in range(40)]
    target = [text(9) for _ in range(20)] + [None, ""]
    got = importance.resample(
        spark.createDataFrame([(i, x, "extra", 1.0) for i, x in docs], "doc_id long, text string, score string, rank double"),
        spark.createDataFrame([(x, 3) for x in target], "text string, weight int"), share=20, least_words=5, buckets=97, ngrams=ngrams,
    )
    assert sorted((tuple(r) for r in got.collect()), key=repr) == drawn_by_force(docs, target, ngrams, 5, 20, 97)


def test_ranks_stand_over_many_ranges(spark):
    rows = [(i % 50, i // 7 % 11) for i in range(2000)]
    got = importance.ranked(spark.createDataFrame(rows, "doc_id long, score long"), 23).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 2001))
    assert [(r["score"], r["doc_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(s, i) for i, s in sorted(rows, key=lambda r: (-r[1], r[0]))]


def test_resample_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(docs, docs).collect() == []
    some = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in importance.resample(some, docs).collect()} == {(1, 3, None), (2, 0, None)}


def clusters_by_force(vectors, k, rounds, dim, scale=1024, seed="3"):
    """(id, cluster, distance) and centroids, every distance computed in Python's integers."""
    ok = lambda v: v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v], v) for i, v in vectors if ok(v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[2]))[:k]
    centres = [r[1] for r in first]
    for turn in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(x, c)) for c in centres] for _, x, _ in kept]
        own = [min(range(len(centres)), key=lambda j: (row[j], j)) for row in d]
        if turn < rounds:
            for j in range(len(centres)):
                if members := [x for (_, x, _), o in zip(kept, own) if o == j]:
                    centres[j] = [sum(col) // len(members) for col in zip(*members)]
    return [(i, o, row[o]) for (i, _, _), o, row in zip(kept, own, d)], centres


@pytest.mark.parametrize("kind", ["spread", "ties", "large"])
def test_clusters_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    dim, n = (4, 400) if kind != "ties" else (2, 400)
    if kind == "ties":  # few places, so that many vectors are as near to one centroid as to another
        data = [(i, [float(x) / 1024 for x in rng.integers(-3, 4, dim)]) for i in range(n)]
    else:
        scale = 1.0 if kind == "spread" else 2e4
        data = [(i, (rng.normal(size=dim) * scale + 3 * scale * rng.integers(0, 3)).tolist()) for i in range(n)]
    data += [(5, data[9][1]), (None, data[4][1]), (None, None), (1001, []), (1002, [1.0] * (dim + 1)), (1003, [float("nan")] * dim), (1004, [None] * dim), (1005, [float("inf")] + [0.0] * (dim - 1)), (1006, [0.0] * dim)]
    df = spark.createDataFrame([(i, v, 2) for i, v in data], "vec_id long, embedding array<double>, cluster int").repartition(3)
    rows = [r.asDict() for r in elkan.cluster(df, k=5, rounds=6, dim=dim).collect()]
    want, centres = clusters_by_force(data, 5, 6, dim)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=repr) == sorted(want, key=repr)
    for r in rows:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"]) and r["inertia"] == sum(d for _, _, d in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_bounds_skip_most_distances(spark):
    rng = np.random.default_rng(8)
    data = [(i, (rng.normal(size=8) * 0.05 + 2 * np.eye(8)[i % 6]).tolist()) for i in range(1200)]
    computed: list[int] = []
    elkan.cluster(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=6, rounds=8, dim=8, computed=computed).collect()
    assert len(computed) == 9 and computed[-1] < 1200 * 6 / 5, computed


def test_clusters_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert elkan.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema), dim=2).collect() == []
    rows = elkan.cluster(spark.createDataFrame([(1, [0.5, 0.5]), (2, [-0.5, 0.25]), (2, [-0.5, 0.25])], schema), k=8, dim=2).collect()
    assert {(r["vec_id"], r["distance"]) for r in rows} == {(1, 0), (2, 0)} and len({r["cluster"] for r in rows}) == 2
    huge = elkan.cluster(spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate((0.0, 1.0, 1e30, -1e30))], "vec_id long, embedding array<double>"), k=2, dim=2).collect()
    assert len(huge) == 4 and max(r["distance"] for r in huge) == (1 << 63) - 1
