"""Operators 1, 9 and 10 against brute force, and their edge cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import xxhash

from florilege.llm import curriculum, exact_dedup, simhash
from florilege.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, keep_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, "x", "y", 1) for i, t, s in rows], SCHEMA)


ODD = [(5, None, "a"), (3, "", "a"), (9, "One two THREE four", None), (7, "one TWO three four", ""), (7, "one TWO three four", ""), (None, "É", "é"), (1, "é", "b"), (2, "é", "b"), (4, "w " * 30000, "a")]


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup(spark):
    got = exact_dedup.exact_dedup(frame(spark, ODD)).collect()
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[lower(t)].append(i)
    assert len(got) == len(ODD)
    want = sorted((str(i), max((x for x in groups[lower(t)] if x is not None), default=None), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, _ in ODD)
    assert sorted((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert len({r.text_sha256 for r in got}) == len(groups) == sum(r.kept for r in got)  # one row of each text, of repeated rows too
    for lanes, fan_in in ((8, 2), (4, 4), (256, 16)):
        merged = exact_dedup.merge_runs(exact_dedup.digest_entries(frame(spark, ODD).repartition(5)), lanes=lanes, fan_in=fan_in).collect()
        assert sorted(((r.keep_id, r.group_size) for r in merged), key=str) == sorted({(r.keep_id, r.group_size) for r in got}, key=str)
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0
    smallest = exact_dedup.exact_dedup(frame(spark, ODD), keep="smallest").collect()
    assert {r.keep_id for r in smallest if r.doc_id in (7, 9)} == {7}


def plain_fingerprint(text):
    words = lower(text).encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_fingerprint_matches_spark_and_brute_force(spark):
    for t in [x[1] for x in ODD[:8]] + ["a b", "a b c", "x y z w", "A\x0bB\tC D e f g"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    one = spark.sql("SELECT xxhash64('one two three')").first()[0] % 2**64
    assert one == xxhash.xxh64_intdigest(b"one two three", 42)


def brute(fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            least = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 3)
            changed |= least != label[i]
            label[i] = least
    return label


def test_links_against_brute_force(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(25):
        base = rng.getrandbits(64)
        fps += {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4)))) for _ in range(8)}
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    want = brute(fps)
    for most in (512, 1):
        found = dict((r.node, r.component) for r in components(simhash.links(nodes, most)).collect())
        assert [found.get(i, i) for i in range(len(fps))] == want, most


def test_a_key_of_very_many_fingerprints(spark):
    """3,000 fingerprints under one 32-bit key, by hubs; in pairs where each has under 512."""
    rng = random.Random(8)
    low = set()
    while len(low) < 3000:
        base = rng.getrandbits(32)
        low |= {base, base ^ 1 << rng.randrange(32), base ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32)}
    fps = sorted(0xABCDEF01 << 32 | x for x in low)
    nodes = spark.createDataFrame([(i, f - (1 << 64)) for i, f in enumerate(fps)], "node long, fp long")
    near = {i: [i] for i in range(len(fps))}
    x = np.array(fps, np.uint64)
    for i in range(len(fps)):
        near[i] = np.flatnonzero(np.bitwise_count(x ^ x[i]) <= 3).tolist()
    label, todo = {}, list(range(len(fps)))
    for i in todo:
        stack = [i] if i not in label else []
        while stack:
            j = stack.pop()
            if j not in label:
                label[j] = i
                stack += near[j]
    found = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    assert all(found.get(i, i) == label[i] for i in range(len(fps)))


def test_near_duplicates_edges(spark):
    got = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[5, "0" * 16] == by[3, "0" * 16] == 3
    assert {r.component_id for r in got if r.doc_id in (7, 9)} == {7}
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    # ids of any type and size: strings, and longs up to the largest
    texts = ["a b c d", "A b  c d", "x y z w", ""]
    for ids, kind in ((["q", "p", None, "o"], "string"), ([2**63 - 1, 2**62, None, -(2**63)], "long")):
        rows = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts)), f"doc_id {kind}, text string")).collect()
        assert {(r.doc_id, r.component_id) for r in rows} == {(ids[0], ids[1]), (ids[1], ids[1]), (None, None), (ids[3], ids[3])}


def test_components_of_a_path(spark):
    n = 60
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(i, 0) for i in range(n)}


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "a", "a", "a", "b", "c", None, ""])) for i in range(100, 400)] + ODD
    got = curriculum.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    size, take, target = defaultdict(int), defaultdict(int), {}
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r.doc_id]
        size[s] += r["size"]
        take[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    total, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, free = {}, set(names)
    while True:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        want |= {s: 3 * size[s] for s in over}
        free -= over
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(take[s] - target[s]) <= 0.5
    again = curriculum.mix(frame(spark, rows[::-1])).collect()
    assert [r.asDict() for r in again] == [r.asDict() for r in got]
    at = [r.position for r in got if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert curriculum.mix(frame(spark, [])).count() == 0
    words = defaultdict(int)
    for r in curriculum.passes(frame(spark, rows)).collect():
        words[r.doc_id] += r.words
    assert {r.doc_id: r.taken for r in got if r.taken and r.doc_id != 7} == {k: v for k, v in words.items() if k != 7}
