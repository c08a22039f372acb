"""The pipeline against a brute-force version of its stages on a small fixture."""

import random
import uuid
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from florilege.llm import crossparse, curriculum, shared, simhash


def fixture(n=160):
    rng = random.Random(11)
    stems = {"aa": "the and ing tion er", "bb": "der und ung lich sch"}
    rows = []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        text = " ".join("".join(rng.choices(stems[lang].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60)))
        rows.append((i, text, lang, rng.choice(["s0", "s0", "s0", "s1", None])))
    for k in range(30):
        rows.append((n + k, rows[k][1].upper() if k % 2 else rows[k][1] + " x", rows[k][2], "s1"))
    rows += [(900, "123 456", "aa", "s0"), (901, None, "aa", "s0"), (902, "", None, None)]
    return [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]


def lower(t):
    return "".join(c.lower() if c < "\x80" else c for c in t)


def test_stages_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, parser = docs.columns, crossparse.CrossParser(crossparse.training_samples(docs))
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    step = dict(corpus_pipeline.STAGES)

    known = step["language ID"](spark, docs, "")
    langs = parser.predict([r[1] for r in rows])[0]
    left = [r for r, lang in zip(rows, langs) if lang != "und"]
    assert known.columns == columns and sorted(map(tuple, known.collect())) == sorted(left)

    unique = step["exact dedup"](spark, known, "")
    last = {}
    for r in left:
        last[lower(r[1])] = max(last.get(lower(r[1]), -1), r[0])
    left = [r for r in left if last[lower(r[1])] == r[0]]
    assert unique.columns == columns and sorted(map(tuple, unique.collect())) == sorted(left)

    apart = step["SimHash near-dedup"](spark, unique, "")
    prints = {r[0]: simhash.fingerprint(r[1]) for r in left}
    label = {i: i for i in prints}
    for _ in range(len(prints)):
        new = {i: min(label[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3) for i in prints}
        if new == label:
            break
        label = new
    left = [r for r in left if label[r[0]] == r[0]]
    assert apart.columns == columns and sorted(map(tuple, apart.collect())) == sorted(left)

    mixed = step["mixing sources"](spark, apart, "")
    got = Counter(r.doc_id for r in mixed.collect())
    taken = {r.doc_id: (r.taken, r["size"]) for r in curriculum.mix(apart).collect()}
    assert mixed.columns == columns
    for i, (words, size) in taken.items():
        assert got[i] in (words // size, words // size + 1) and abs(got[i] * size - words) <= size / 2 + 1

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r[0]: r[1] for r in rows}
    encoded = step["SentencePiece encoding"](spark, mixed, "").collect()
    assert Counter(r.doc_id for r in encoded) == got
    assert all(list(r.ids) == sp.encode(text[r.doc_id]) and r.exact for r in encoded)


@pytest.mark.parametrize("written", [False, True])
def test_null_and_repeated_doc_ids(spark, tmp_path, written):
    """Rows named by a number that is written with them, and by their files."""
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choices("the and ing tion er".split(), k=3)) for _ in range(40))
    a, b, c, d, e, f, g, near = (line() for _ in range(8))
    close = "\t" + near.replace(" ", "  ")  # another text with the same words
    ids = [(None, a), (None, a.upper()), (None, b), (7, c), (7, c), (8, d), (8, e), (9, e), (None, e), (5, f), (5, g), (6, near), (6, close), (None, near + "\n"), (8, close + " ")]
    docs = spark.createDataFrame([(i, t, "aa", "s", n) for n, (i, t) in enumerate(ids)] + [(100 + n, line(), "aa", "s", 100 + n) for n in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    def stored(df):
        if not written:
            return df
        path = f"{tmp_path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    step = {name: lambda s, d, f, stage=stage: stored(stage(s, stored(d), f)) for name, stage in corpus_pipeline.STAGES}
    known = step["language ID"](spark, docs, "")
    assert known.count() == docs.count()

    def told(df):
        return sorted(((r.doc_id, r.text.lower()) for r in df.collect() if r.n_chars < 100), key=str)

    low = lambda rows: sorted(((i, t.lower()) for i, t in rows), key=str)
    unique = step["exact dedup"](spark, known, "")
    left = [(None, a), (None, b), (7, c), (8, d), (9, e), (5, f), (5, g)]
    assert told(unique) == low([*left, (6, near), (6, close), (None, near + "\n"), (8, close + " ")])
    apart = step["SimHash near-dedup"](spark, unique, "")
    assert [x for x in told(apart) if x[0] != 6] == low(left) and sum(x[0] == 6 for x in told(apart)) == 1
    plain = apart.collect()
    mixed = step["mixing sources"](spark, apart, "")
    # one source of 40-word texts: its target is its size, and every row is there once
    assert sorted(map(str, mixed.collect())) == sorted(map(str, plain))
    # the same rows at every id null, and at one id
    for same in ("cast(null AS long)", "cast(1 AS long)"):
        alike = known.selectExpr(f"{same} AS doc_id", "text", "lang", "source", "n_chars")
        for name in ("exact dedup", "SimHash near-dedup", "mixing sources"):
            alike = step[name](spark, alike, "")
        assert sorted(set(r.text.lower().strip() for r in alike.collect()) - {near.lower(), close.strip().lower()}) == sorted(set(r.text.lower().strip() for r in plain) - {near.lower(), close.strip().lower()})
        assert alike.count() == len(plain)
    assert step["SentencePiece encoding"](spark, mixed, "").count() == len(plain)


def test_columns_with_clashing_names(spark):
    names = "position pass part row_number place size words mask row id key fp component_id keep_id kept best src ord Row_Number a.b".split()
    rows = [(i, t, lang, s, n, *[f"{k}{i}" for k in range(len(names))]) for i, t, lang, s, n in fixture(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names)
    spark.conf.set("spark.sql.caseSensitive", "true")  # for a name in two spellings
    try:
        docs = spark.createDataFrame(rows, schema)
        plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs, plain = stage(spark, docs, ""), stage(spark, plain, "")
            assert [c.lower() for c in docs.columns] == [c.lower() for c in ["doc_id", "text", "lang", "source", "n_chars", *names]]
            got = docs.collect()
            assert sorted(tuple(r)[:5] for r in got) == sorted(map(tuple, plain.collect())) or name == "language ID"
            assert all(tuple(r)[5:] == tuple(f"{k}{r[0]}" for k in range(len(names))) for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(got)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_run_leaves_only_what_its_result_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "scratch_root", lambda spark: f"file://{tmp_path}/shared")
    spark.createDataFrame(fixture(60), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/in").count() > 0
    assert [p.name.split("-")[1] for p in (tmp_path / "shared/florilege").iterdir()] == ["mixing"]


def test_empty_pipeline(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
