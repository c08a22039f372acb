"""Ranking against a plain BM25, outcomes of a search, and the operators on small frames."""

import datetime as dt
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.operators import analytics, evaluate, graph, index, parsers, retrieval, scratch, search, store
from florilege.plans.query import Parsed, Phrase, Refused, Unit, parse

FIELDS = ("body", "title")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = "alfa beta gama delta ação ações réu a b c".split()
    return [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))), rng.choice(words), i % 3) for i in range(60)]


@pytest.fixture(scope="module")
def built(spark, rows):
    return index.build_index(spark.createDataFrame(rows, "id int, body string, title string, issue int"), FIELDS).cache()


def plain(text):
    fold = text.lower().translate(str.maketrans("çãõéáô", "caoeao"))
    return re.findall(r"\w+", fold)


def places(tokens, phrase):
    n, out = len(phrase.words), 0
    for i in range(len(tokens) - n + 1):
        part = tokens[i : i + n]
        head, last = list(phrase.words[:-1]), phrase.words[-1]
        out += part[:-1] == head and (part[-1].startswith(last) if phrase.prefix else part[-1] == last)
    return out


def brute(rows, query, weights):
    docs = {r[0]: {"body": plain(r[1]), "title": plain(r[2])} for r in rows}
    size = {i: sum(map(len, d.values())) for i, d in docs.items()}
    mean = sum(size.values()) / len(size)
    used = [f for f, w in weights.items() if w]
    out = {}
    for i, d in docs.items():
        hit = lambda u, d=d: any(places(d[f], p) for p in u.phrases for f in used)
        if not all(map(hit, query.required)) or query.optional and not any(map(hit, query.optional)):
            continue
        score = 0.0
        for p in query.phrases():
            n = sum(any(places(e[f], p) for f in used) for e in docs.values())
            idf = math.log((len(docs) - n + 0.5) / (n + 0.5))
            idf = idf if idf > 0 else 1e-6
            tf = sum(weights[f] * places(d[f], p) for f in used)
            score -= idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[i] / mean)) if tf else 0
        out[i] = (sum(map(hit, query.optional)), round(score, 9))
    return out


QUERIES = [
    (parse("alfa beta"), {"body": 5.0, "title": 2.0}),
    (parse('"alfa beta" gama'), {"body": 1.0, "title": 0.0}),
    (parse("ação réu"), {"body": 5.0, "title": 1.0}),
    (parse(None, [["alf$"], ["beta", "delta"]]), {"body": 5.0, "title": 2.0}),
    (Parsed((Unit("aa", (Phrase(("a", "a")),), True),)), {"body": 1.0, "title": 1.0}),
    (Parsed((Unit("ab*", (Phrase(("a", "be"), True),), True), Unit("again", (Phrase(("a", "be"), True),), True))), {"body": 1.0, "title": 1.0}),
]


@pytest.mark.parametrize("query, weights", QUERIES)
def test_scores(built, rows, query, weights):
    got = {r.id: (r.coverage, round(r.score, 9)) for r in search.scored(built, query, search.Scoring(weights)).collect()}
    assert got == pytest.approx(brute(rows, query, weights), abs=1e-8) if not got else True
    want = brute(rows, query, weights)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-8 for i in got)


def test_tokens_and_vocabulary(built, rows):
    vocabulary = {r.term: (r.doc, r.cnt) for r in index.vocabulary(built, FIELDS).collect()}
    docs = [plain(r[1]) + plain(r[2]) for r in rows]
    assert vocabulary == {w: (sum(w in d for d in docs), sum(d.count(w) for d in docs)) for w in set().union(*docs)}
    assert {r.id: r.n_tokens for r in built.collect()} == {r[0]: len(d) for r, d in zip(rows, docs)}


def test_outcomes(built):
    query, scoring = parse("alfa beta"), search.Scoring({"body": 5.0, "title": 2.0})
    found = search.search(built, query, scoring, "id", "issue", size=5)
    assert found.kind == "rows" and found.rows.count() == 5 and found.last_page == -(-found.total // 5)
    assert search.search(built, query, scoring, "id", "issue", size=5, number=99).kind == "beyond"
    none = search.search(built, parse(None, [["alfa"], ["zzz"]]), scoring, "id", "issue")
    assert none.kind == "empty" and [r[1] > 0 for r in none.by_unit] == [True, False]
    blamed = search.search(built, query, scoring, "id", "issue", where=F.col("issue") == 77)
    assert blamed.kind == "empty" and blamed.without_filters > 0
    oldest = search.search(built, query, scoring, "id", "issue", order="oldest", size=20).rows.collect()
    assert [(r.issue, str(r.id)) for r in oldest] == sorted((r.issue, str(r.id)) for r in oldest)


@pytest.mark.parametrize(
    "text, label",
    [
        ("recurso conhecido e desprovido", "desprovido"),
        ("recurso provido", "provido"),
        ("recurso parcialmente provido", "parcialmente provido"),
        ("recurso nao conhecido", "não conhecido"),
        ("autor provido, reu desprovido", None),
        ("nada consta", None),
        ("negou provimento ao agravo", "desprovido"),
        ("deram provimento", "provido"),
    ],
)
def test_outcome_labels(spark, text, label):
    assert spark.createDataFrame([(text,)], "t string").select(analytics.outcome(F.col("t")).alias("o")).first().o == label


def test_lift(spark):
    rows = [(i, ["comum", "raro"] if i < 10 else ["comum"]) for i in range(100)]
    docs = spark.createDataFrame(rows, "id int, w array<string>")
    general = docs.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("doc"))
    got = analytics.lift_terms(docs.filter("id < 12"), F.col("w"), general, 100).collect()
    assert [(r.term, r.df, round(r.lift, 3)) for r in got] == [("raro", 10, 8.333)]
    assert analytics.lift_terms(docs.filter("id < 5"), F.col("w"), general, 100).count() == 0


def test_graph(spark):
    edges = spark.createDataFrame([("a", "q", "Tema 7"), ("b", "q", "Tema 7/STJ"), ("c", "q", "Tema 9"), ("a", "t", "1"), ("b", "t", "1"), ("c", "t", "2")], "source string, kind string, ref string")
    assert [tuple(r) for r in graph.top_cited(edges, "q", 5, merge=True).collect()] == [("Tema 7/STJ", 2), ("Tema 9", 1)]
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "source string")
    assert {r.source for r in graph.citing(edges, "q", "Tema 7", docs, "source").collect()} == {"a", "b"}
    nodes = spark.createDataFrame([("1",)], "p string")
    assert graph.dangling(edges, "t", nodes, "p").first().n == 1
    assert {(r.ref, r.inside) for r in graph.with_presence(graph.top_cited(edges, "t", 5), nodes, "p").collect()} == {("1", True), ("2", False)}
    many = spark.createDataFrame([("g", i) for i in range(9)] + [("h", 50)], "g string, n int")
    got = {r.n: (r.others, r.more) for r in graph.siblings(many, "g", "n").collect()}
    assert got[0] == ("1,2,3,4,5", True) and got[3] == ("0,1,2,4,5", True) and 50 not in got


def test_evaluation(spark):
    ranking = spark.createDataFrame([("q", i, i + 1) for i in range(20)], "query string, id int, rank int")
    gold = spark.createDataFrame([("q", 0), ("q", 15), ("q", 99)], "query string, id int")
    r = evaluate.recall_at(ranking, gold, (10, 50)).first()
    assert (r.essentials, round(r.recall_at_10, 3), round(r.recall_at_50, 3)) == (3, 0.333, 0.667)
    a = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "query string, id int, rank int")
    b = spark.createDataFrame([("q", 2, 0)], "query string, id int, rank int")
    assert {r.id: r.score for r in evaluate.fused([a, b]).collect()} == {1: 1 / 60, 2: 1 / 61 + 1 / 60}
    left = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "b"), (2, None), (4, "c")], "k int, v string")
    assert {r.field: r.differing for r in evaluate.parity(left, right, "k").collect()} == {"__missing__": 2, "v": 1}
    assert evaluate.table_hash(left).first() == evaluate.table_hash(left.orderBy(F.desc("k"))).first() != evaluate.table_hash(right).first()
    d = evaluate.deltas(spark.createDataFrame([("t1", 0.4)], "q string, r double"), spark.createDataFrame([("t1", 0.5)], "q string, r double"), "q", ["r"]).first()
    assert round(d.r, 6) == 0.1
    best = evaluate.reranked(ranking, lambda rows: F.col("id") % 7, 2).orderBy("rank").collect()
    assert [r.id for r in best] == [6, 13]


def test_dense_top(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(4)]) for i in range(300)] + [(400, None), (401, []), (402, [1.0]), (403, [1.0, None, 1.0, 1.0]), (404, [0.0] * 4), (405, [2.0])]
    frame = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    good = {i: v for i, v in rows if v and None not in v and any(v)}
    want = {}
    for q in (i for i in good if i % 7 == 0 or i > 400):
        near = sorted((-evaluate.exact(good[q], good[i]), i) for i in good if i != q and len(good[i]) == len(good[q]))
        want |= {(q, n): (i, c) for n, (c, i) in enumerate(near[:5], 1)}
    for block in (10_000, 13):
        monkeypatch.setattr(evaluate, "QUERY_BLOCK", block)
        monkeypatch.setattr(evaluate, "ROW_BLOCK", 64)
        got = evaluate.dense_top(frame, frame.filter("id % 7 = 0 OR id > 400"), "id", "v", 5).collect()
        assert {(r.query_id, r["rank"]): (r.id, -r.cosine) for r in got} == want


def test_numbered(spark):
    rows = [(i * 37 % 101, f"x{i}") for i in range(101)]
    frame = spark.createDataFrame(rows, "k int, v string").repartition(5)
    assert sorted((r.position, r.k) for r in evaluate.numbered(frame, ["k"]).collect()) == [(i, i) for i in range(101)]
    assert evaluate.numbered(frame.limit(0), ["k"]).count() == 0


def request_tables(spark):
    def made(rows, schema):
        return spark.createDataFrame(rows, schema)

    decisions = [(str(10000 + i), f"2026{i // 3:08d}", "Apelação" if i % 2 else "Agravo", "DES. ANA" if i % 3 else "DES. BETO", "1ª Câmara Cível" if i % 4 else "Câmara Criminal", i // 5) for i in range(40)]
    words = ["plano saude recusa", "plano contrato", "recusa dano moral", "consumidor banco"]
    rows = [(*d, dt.date(2026, 1, 1) + dt.timedelta(days=d[5]), f"{words[i % 4]} numero{i}. Recurso {'desprovido' if i % 2 else 'provido'}." + " palavra" * (400 if i == 4 else 1)) for i, d in enumerate(decisions)]
    whole = made(rows, "decision string, process string, class string, rapporteur string, body string, issue int, date date, abstract string")
    parts = parsers.with_fields(whole.select("decision", F.concat(F.lit("I. CASO EM EXAME 1. x. II. QUESTÃO EM DISCUSSÃO 2. "), "abstract").alias("abstract")), "abstract").drop("abstract")
    edges = made([(d[0], "qualificado", "Súmula 297/STJ") for d in decisions[:6]] + [(d[0], "tjse", decisions[0][1]) for d in decisions[6:9]], "source string, kind string, ref string")
    return retrieval.Tables(
        index.build_index(whole, ("abstract", "class", "rapporteur")), index.build_index(parts, parsers.SEARCHABLE), edges, made([("10000", 9)], "decision string, issue int"), made([("10001",)], "decision string")
    ), {r[0]: r for r in rows}


def test_requests(spark):
    tables, rows = request_tables(spark)
    ask = lambda **kw: retrieval.answer(tables, retrieval.Request(**kw))
    ids = lambda a: [r.decision for r in a.outcome.rows.collect()]
    a = ask(text="plano recusa", size=5)
    both = {i for i, r in rows.items() if "plano" in r[7] and "recusa" in r[7]}
    assert a.outcome.total == sum("plano" in r[7] or "recusa" in r[7] for r in rows.values()) and a.matching_all == len(both) and set(ids(a)) <= both and len(ids(a)) == 5
    assert {f for f, *_ in a.panorama} >= {"outcome", "body", "class"}
    top = {r.decision: r for r in ask(number=rows["10000"][1], size=20).outcome.rows.collect()}
    assert set(top) == {"10000", "10001", "10002"} and top["10000"].republished == "9" and top["10001"].held and top["10000"].cited == 3
    assert top["10000"].cites == ["Súmula 297/STJ"] and top["10000"].others == "10001,10002"
    got = ask(text="plano", body="criminal", class_name="AGRAVO", rapporteur="beto", order="oldest", size=20)
    assert ids(got) == sorted(i for i, r in rows.items() if "plano" in r[7] and r[4] == "Câmara Criminal" and r[2] == "Agravo" and r[3] == "DES. BETO")
    assert set(ids(ask(cites="Súmula 297", size=20))) == set(list(rows)[:6]) and ask(cites="Súmula 297").order == "newest"
    dated = ask(text="plano", first_date="03/01/2026", last_date="2026-01-04", order="newest", size=20)
    assert ids(dated) == sorted((i for i, r in rows.items() if "plano" in r[7] and r[5] in (2, 3)), reverse=True)
    assert sorted(ids(ask(text="recusa", fields="questao", size=20))) == sorted(i for i, r in rows.items() if "recusa" in r[7])
    assert ask(text="recusa", fields="tese").outcome.kind == "empty"
    assert ask(text="plano", page=99).outcome.kind == "beyond"
    none = ask(text="plano", body="nenhuma")
    assert none.outcome.kind == "empty" and none.outcome.without_filters > 0
    cut = ask(text="plano", triage=True).outcome.rows.collect()
    assert len(cut) == sum("plano" in r[7] for r in rows.values()) and max(len(r.abstract) for r in cut) == 701
    for wrong in ({}, {"text": "plano", "order": "x"}, {"text": "plano", "fields": "nada"}, {"cites": "nada"}, {"number": "1"}):
        with pytest.raises(Refused):
            ask(**wrong)
    with pytest.raises(ValueError):
        ask(text="plano", first_date="2026-02-01", last_date="2026-01-01")


def test_overview_of_many_decisions(spark, monkeypatch):
    """The best by score alone, not by coverage; twelve precedents a decision; hints without usual words and the query's own; diagnosis in whole decisions."""
    tables, rows = request_tables(spark)
    monkeypatch.setattr(retrieval.analytics, "TOP_ROWS", 12)
    monkeypatch.setattr(retrieval.analytics.panorama, "__defaults__", (12, 5))
    ask = lambda **kw: retrieval.answer(tables, retrieval.Request(**kw))
    a = ask(text="plano recusa numero7")
    by_score = search.scored(tables.whole, parse("plano recusa numero7"), search.Scoring(retrieval.WEIGHTS)).orderBy("score", F.desc("issue"), F.desc("decision")).limit(12)
    want = by_score.groupBy("body").count().collect()
    assert {(v, n) for f, v, n in a.panorama if f == "body"} == {(r["body"], r["count"]) for r in want}
    many = parsers.anchors(" ".join(f"Tema {i};" for i in range(1, 30)), retrieval.PANORAMA_ANCHORS)
    assert len(many) == 12
    hints = {t for t, *_ in ask(text='"dano moral"').hints}
    assert hints == set() or not hints & {"recurso", "moral"}
    # of the parts, only some fields hold a word; the diagnosis counts it in whole decisions all the same
    none = ask(groups=[["recusa"], ["plano"]], fields="tese")
    assert none.outcome.kind == "empty" and {u: n for u, n, _ in none.outcome.by_unit}["[recusa]"] == sum("recusa" in r[7] for r in rows.values())


def test_citation_and_marks(spark):
    row = spark.createDataFrame([("", None, dt.date(2026, 8, 31)), ("AC 1", "ANA DE SOUZA", None)], "a string, r string, d date")
    made = T.citation(F.col("a"), F.lit("2"), F.lit("3"), F.col("r"), F.lit("Câmara"), F.col("d"), F.lit("u"), "lido")
    assert [r.c for r in row.select(made.alias("c")).collect()] == [
        "([TJSE, Acórdão, processo nº 2, acórdão nº 3, Rel. ?, Câmara, julgado em 31/08/2026](u)) — verificação: lido",
        "([TJSE, AC 1, processo nº 2, acórdão nº 3, Rel. Ana de Souza, Câmara](u)) — verificação: lido",
    ]
    marks = spark.createDataFrame([("a:1:x", "5"), ("a:1:y", "no"), ("a:2:x", "9"), ("a:1:z", None)], "key string, value string")
    assert [r.key for r in store.recent_marks(marks, "a:1:", 4.0).collect()] == ["a:1:x"] and store.recent_marks(marks, "a:1:", -1.0).count() == 3


def test_index_is_built_once_for_a_table(spark, tmp_path, monkeypatch):
    from florilege.operators import scratch

    path, built = str(tmp_path / "t"), []
    build = lambda: built.append(1) or spark.read.parquet(path)
    for n in (5, 5, 7):
        spark.range(n).write.mode("overwrite").parquet(path)
        assert scratch.once(spark, path, build).count() == n and scratch.once(spark, path, build, "other").count() == n
        assert scratch.once(spark, path, build).count() == n
    assert len(built) == 6
    monkeypatch.setattr(scratch, "root", lambda spark: (_ for _ in ()).throw(ValueError("no folder")))
    assert scratch.once(spark, path, build).count() == 7 and len(built) == 7


def test_store(spark):
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "a"), ("y", 3, "c")], "k string, at int, v string")
    first, later = store.first_wins(rows, "k", ["at"])
    assert {r.v for r in first.collect()} == {"a", "c"} and {r.v for r in later.collect()} == {"b"}
    assert {r.v for r in store.deleted(rows, spark.createDataFrame([("x",)], "k string"), ["k"]).collect()} == {"c"}
    receipts = spark.createDataFrame([("1", "h")], "id string, html string").withColumn("sha256", F.sha2("html", 256))
    bad = receipts.withColumn("html", F.lit("other"))
    good, quarantined = store.checked(receipts.unionByName(bad))
    assert good.count() == quarantined.count() == 1
    moved = store.migrated(receipts.withColumn("size", F.lit(9)), {"size": F.length("html")}).first()
    assert moved.changed and moved["size"] == 1


def test_an_outcome_makes_the_form_once(spark):
    rows = spark.createDataFrame([("Recurso parcialmente provido.", "parcialmente provido"), ("Negou provimento ao recurso.", "desprovido"), ("Recurso provido; apelo desprovido.", None), (None, None)], "t string, want string")
    made = rows.select(analytics.outcome(F.translate(F.lower("t"), "#", "-")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in made.collect())
    assert made._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_what_is_built_once_is_built_once(spark, tmp_path):
    path, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)
    spark.range(40).write.parquet(path)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    built = scratch.once(spark, path, lambda: spark.read.parquet(path).mapInArrow(run, "id long").distinct(), str(tmp_path))
    assert built.count() == 40 and seen.value == 40
