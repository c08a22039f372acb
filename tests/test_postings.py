"""Postings in segments: same rows and scores as the scan, blocks passed over, shelves unread, any sequence of changes as built anew."""

import random

import pytest
from pyspark.sql import functions as F

from florilege.operators import index, postings, search
from florilege.plans.query import Parsed, Phrase, Unit, parse

FIELDS = ("title", "body")
SCHEMA = "id long, issue int, title string, body string"


def texts(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = ["a", "ab", "abc", "ação", "Acao", "über", "x1", *(f"w{i}" for i in range(words))]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda m: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(m)))
    return [(i, rng.randrange(5), text(4), text(30)) for i in range(n)] + [(n, 1, None, None), (n + 1, 1, "", "a a a a"), (n + 2, 2, "a ab", "abc, ação; a-ab")]


QUERIES = [
    parse("acao w3 w9"),
    parse('"a a" uber'),
    parse('"a ab" "abc a"', [["w2", "w3"], ["a", "uber"]]),
    parse(None, [["w1*", "abc"], ["a ab*"]]),
    Parsed((Unit("u", (Phrase(("a",)), Phrase(("a", "a"))), True), Unit("v", (Phrase(("a",)),), False), Unit("w", (Phrase(("zz",)),), False))),
    Parsed((Unit("none", (Phrase(("zz",), True),), True),)),
]
WEIGHTS = [{"title": 2.0, "body": 1.0}, {"title": 0.0, "body": 3.0}, {"title": 0.5, "body": 0.0}]


def figures(rows):
    return sorted((r["id"], r["coverage"], round(r["score"], 9)) for r in rows.select("id", "coverage", "score").collect())


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    docs = spark.createDataFrame(texts(1, 300), SCHEMA).repartition(3)
    folder = str(tmp_path_factory.mktemp("index"))
    return index.build_index(docs, FIELDS).cache(), postings.created(docs, folder, FIELDS, "id", shelves=9, block=8)


@pytest.mark.parametrize("k", range(len(QUERIES)))
def test_scores_are_those_of_the_scan(both, k):
    scanned, indexed = both
    for weights in WEIGHTS[: 3 if k < 2 else 1]:
        scoring = search.Scoring(weights)
        assert figures(postings.scored(indexed, QUERIES[k], scoring)) == figures(search.scored(scanned, QUERIES[k], scoring))


def test_the_first_are_those_of_scoring_all(both, spark):
    scanned, indexed = both
    rng = random.Random(3)
    words = ["a", "ab", "abc", "acao", "uber", *(f"w{i}" for i in range(40))]
    for _ in range(5):
        query = Parsed(tuple(Unit(w, (Phrase((w,)),), False) for w in rng.sample(words, rng.randrange(1, 4))))
        scoring = search.Scoring(rng.choice(WEIGHTS[:2]))
        where = rng.choice([None, F.col("issue") > 1])
        rows = search.scored(scanned, query, scoring)
        want = search.page(rows if where is None else rows.filter(where), search.ranked(rows, query, "issue", "id"), 7)
        got = postings.top(indexed, query, scoring, 7, "issue", where, wave=3)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()]


def test_blocks_that_cannot_win_are_not_scored(spark, tmp_path):
    """Few documents speak of the word: the others' blocks hold it once, beside much else."""
    rows = [(i, 0, "t", "gold " * (9 if i % 97 == 0 else 1) + f"w{i} " * (0 if i % 97 == 0 else 30)) for i in range(1500)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    indexed, told = postings.created(docs, str(tmp_path), ("body",), "id", shelves=4, block=16), {}
    query = parse("gold")
    got = postings.top(indexed, query, search.Scoring({"body": 1.0}), 5, "issue", wave=8, told=told).collect()
    every = search.scored(index.build_index(docs, ("body",)), query, search.Scoring({"body": 1.0}))
    assert [r["id"] for r in got] == [r["id"] for r in search.page(every, search.ranked(every, query, "issue", "id"), 5).collect()]
    assert told["blocks"] == 94 and told["scored"] < 20, told


def files_read(df) -> int:
    """Files that the scans of a plan that has run opened."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(s.metrics().apply("numFiles").value() for s in scans if s.metrics().contains("numFiles"))


def test_only_the_words_shelves_are_opened(both, spark):
    _, indexed = both
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole = files_read(postings.read(spark, indexed.segments[0], "postings"))
        one = files_read(indexed.rows("postings", [("w31", False)]))
        prefix = files_read(indexed.rows("postings", [("w3", True)]))
        none = files_read(indexed.rows("postings", [("zz", False)]))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert whole >= 7 and one <= 2 and prefix <= 3 and none == 0, (whole, one, prefix, none)


def test_the_vocabulary_is_that_of_the_texts(both):
    scanned, indexed = both
    want = index.vocabulary(scanned, FIELDS)
    assert sorted(map(tuple, postings.vocabulary(indexed).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_changes_give_what_building_anew_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    known = {r[0]: r for r in texts(seed, 40)}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(2)
    indexed = postings.created(frame(list(known.values())), str(tmp_path), FIELDS, "id", shelves=3, block=4)
    for turn in range(5):
        step = rng.choice(["add", "replace", "delete", "merge"]) if turn else "add"
        if step in ("add", "replace"):
            new = texts(100 * seed + turn, rng.randrange(1, 12))
            new = [((1000 * (turn + 1) if step == "add" else 0) + r[0], *r[1:]) for r in new]
            known |= {r[0]: r for r in new}
            indexed = postings.added(indexed, frame(new), shelves=3, block=4)
        elif step == "delete":
            away = [(i,) for i in rng.sample(sorted(known), len(known) // 4)] + [(-1,)]
            known = {i: r for i, r in known.items() if (i,) not in away}
            indexed = postings.deleted(indexed, spark.createDataFrame(away, "id long"))
        else:
            indexed = postings.merged(indexed, 2, shelves=3, block=4)
    indexed = postings.opened(spark, str(tmp_path))
    assert sorted(r["id"] for r in indexed.docs().select("id").collect()) == sorted(known)
    anew = index.build_index(frame(list(known.values())), FIELDS)
    for query in (QUERIES[0], QUERIES[2]):
        assert figures(postings.scored(indexed, query, search.Scoring(WEIGHTS[0]))) == figures(search.scored(anew, query, search.Scoring(WEIGHTS[0])))
    assert sorted(map(tuple, postings.vocabulary(indexed).collect())) == sorted(map(tuple, index.vocabulary(anew, FIELDS).collect()))
    small = postings.merged(indexed, 2, shelves=3, block=4)
    assert len(small.segments) <= len(indexed.segments) and sorted(r["id"] for r in small.docs().select("id").collect()) == sorted(known)


def exchanges(df) -> int:
    df.collect()
    return str(df._jdf.queryExecution().executedPlan()).split("Initial Plan")[0].count("Exchange ")


def test_shelves_grow_with_the_tokens(spark, tmp_path, monkeypatch, both):
    """A task sorts a shelf, so its share is bounded; heads are those of the postings, and the vocabulary needs one shuffle by term."""
    monkeypatch.setattr(postings, "SHELF_TOKENS", 200)
    docs = spark.createDataFrame(texts(5, 200), SCHEMA).coalesce(2)
    indexed = postings.created(docs, str(tmp_path), FIELDS, "id", shelves=2, block=8)
    segment = indexed.segments[0]
    rows, heads = postings.read(spark, segment, "postings"), postings.read(spark, segment, "heads")
    assert rows.select("shelf").distinct().count() > segment.n_tokens / 200 / 2 > 3
    names = ["shelf", "term", "field", "block", "n", "most", "least"]
    want = rows.groupBy(*names[:4]).agg(F.count("*").alias("n"), F.max(F.size("places")).alias("most"), F.min("n_tokens").alias("least"))
    assert sorted(map(tuple, heads.select(names).collect())) == sorted(map(tuple, want.collect()))
    assert exchanges(postings.vocabulary(indexed)) == exchanges(postings.vocabulary(both[1])) == 1


def test_merging_moves_postings_and_makes_none(spark, tmp_path, monkeypatch):
    """Segments with documents gone are merged without reading texts for their words; where most documents are gone, blocks are packed anew."""
    known = {r[0]: r for r in texts(7, 60)}
    later = [(1000 + r[0], *r[1:]) for r in texts(8, 50)] + [(r[0], 3, "a w1", "abc a ab") for r in texts(7, 60)[:5]]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(2)
    two = postings.added(postings.created(frame(list(known.values())), str(tmp_path), FIELDS, "id", shelves=3, block=4), frame(later), shelves=3, block=4)
    known |= {r[0]: r for r in later}

    def held(one, rows):
        assert len(one.segments) == 1 and one.segments[0].n_docs == len(rows) == one.docs().select("id").distinct().count()
        anew = index.build_index(frame(rows), FIELDS)
        for query in QUERIES[:4]:
            assert figures(postings.scored(one, query, search.Scoring(WEIGHTS[0]))) == figures(search.scored(anew, query, search.Scoring(WEIGHTS[0])))
        assert sorted(map(tuple, postings.vocabulary(one).collect())) == sorted(map(tuple, index.vocabulary(anew, FIELDS).collect()))
        names = ["shelf", "term", "field", "block"]
        stand, heads = postings.read(spark, one.segments[0], "postings"), postings.read(spark, one.segments[0], "heads")
        want = stand.groupBy(*names).agg(F.count("*").alias("n"), F.max(F.size("places")).alias("most"), F.min("n_tokens").alias("least"))
        assert sorted(map(tuple, heads.select(*names, "n", "most", "least").collect())) == sorted(map(tuple, want.collect()))
        assert stand.filter(F.col("block") != F.floor(F.col("doc") / 4)).count() == 0

    away = [(i,) for i in sorted(known) if i % 7 == 0]
    with monkeypatch.context() as m:
        m.setattr(postings, "term_rows", None)
        one = postings.merged(postings.deleted(two, spark.createDataFrame(away, "id long")), 2, shelves=3, block=4)
    held(one, [r for r in known.values() if r[0] % 7])
    thin = postings.deleted(two, spark.createDataFrame([(i,) for i in sorted(known) if i % 7], "id long"))
    packed = postings.merged(thin, 2, shelves=3, block=4)
    held(packed, [r for r in known.values() if r[0] % 7 == 0])
    assert postings.read(spark, packed.segments[0], "padded").select(F.floor(F.col("doc") / 4)).distinct().count() < 2 * len(known) / 7 / 4 + 4
