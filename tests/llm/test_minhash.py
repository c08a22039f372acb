"""MinHash near-duplicates against comparing every pair."""

import random

import numpy as np
import pytest

from florilege.llm import minhash


def brute(docs, k=5, percent=85):
    """By row: (id, set size, component id, kept)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def words(t):
        out = "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in (t or "").translate(low)).split(" ")
        return [w for w in out if w]

    sets = []
    for _, t in docs:
        w = words(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        c = min(ids, default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**9)}"
    return words


def corpus(seed=1):
    rng = random.Random(seed)
    base = [[f"t{g}w{rng.randrange(400)}" for _ in range(rng.choice([12, 40, 146, 300]))] for g in range(6)]
    texts = []
    for b in base:
        texts += [" ".join(edited(rng, b, rng.randrange(1, 2 + len(b) // 40))) for _ in range(12)] + [" ".join(b)]
        chain = b
        for _ in range(6):  # a copy of a copy of a copy
            chain = edited(rng, chain, max(1, len(chain) // 90))
            texts.append(" ".join(chain))
        texts.append(" ".join(b).upper())
        texts += [" ".join(b[: len(b) // 2] + [f"x{rng.random()}" for _ in range(len(b) // 2)])]
    texts += ["", None, "  \t\n", "one", "One", "one two three four", "ONE two\tthree  four", "one two three four five", "a a a a a a a", "a a a a a", "Éé é É x", "éé é é x"]
    rng.shuffle(texts)
    docs = [(1000 - i, t) for i, t in enumerate(texts)]
    return docs + [(7, texts[0]), (7, texts[3]), (None, texts[5]), (None, "only without an id, and long enough for a set of its own"), (3, None)]


@pytest.mark.parametrize("block", [256, 3])
def test_components_against_all_pairs(spark, block):
    docs = corpus()
    df = spark.createDataFrame([(d, t, 5, "c") for d, t in docs], "doc_id long, text string, n int, digest string").repartition(5)
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, block=block).collect()), key=repr)
    assert got == brute(docs)


def test_copies_that_only_their_source_links(spark):
    """Each copy is 0.9 like the source and 0.81 like another copy: a star around a copy links nothing."""
    rng = random.Random(4)
    source = [f"w{rng.randrange(5000)}" for _ in range(150)]
    docs = [(i, " ".join(edited(rng, source, 3))) for i in range(1, 300)] + [(500, " ".join(source))]
    # and a second family beside it, like the first but not like enough
    other = edited(rng, source, 8)
    docs += [(600 + i, " ".join(edited(rng, other, 2))) for i in range(60)] + [(700, " ".join(other))]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()), key=repr)
    assert got == brute(docs)


def test_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    agree = []
    for _ in range(200):
        h = rng.integers(0, 1 << 63, 130, np.uint64) * np.uint64(2)
        x, y = np.sort(h[:120]), np.sort(h[10:])  # 110 of 130 shared
        agree.append((minhash.bin_values(x, 216) == minhash.bin_values(y, 216)).mean())
    assert abs(np.mean(agree) - 110 / 130) < 0.02
    one = np.array([5], np.uint64)
    assert (minhash.bin_values(one, 216) == 5).all()


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        h = np.unique(rng.integers(0, 1 << 63, rng.integers(8, 400), np.uint64))
        cut = int(rng.integers(0, max(1, len(h) // 6)))
        x, y = h[cut:], h[: len(h) - int(rng.integers(0, cut + 1))]
        apart = int(np.unpackbits((minhash.parities(x) ^ minhash.parities(y)).view(np.uint8)).sum())
        assert apart <= len(np.setxor1d(x, y))


def test_least_linked():
    assert minhash.least_linked(85) == 6 and minhash.least_linked(50) == 1 and minhash.least_linked(80) == 4


def test_empty_table_and_string_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = minhash.near_duplicates(spark.createDataFrame([("b", "x y z"), ("a", "X  y z"), ("c", "")], "name string, body string"), "name", "body").collect()
    assert {tuple(r) for r in rows} == {("b", 1, "a", False), ("a", 1, "a", True), ("c", 0, "c", True)}
