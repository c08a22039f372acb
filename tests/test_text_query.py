"""Text kernel and query language: golden values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.plans import query as Q


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw, form",
    [
        ("A  Ação nº 123", "a acao n 123"),
        ("§  2º, “sic”", "§2o, 'sic'"),
        ("art . 42 ( x )", "art. 42 (x)"),
        ("Põe–se — já", "poe-se - ja"),
    ],
)
def test_norm(spark, raw, form):
    assert T.norm_py(raw) == form
    assert column(spark, raw, T.norm) == form


def test_norm_ligatures_and_bodies(spark):
    assert T.norm_py("oﬁcial") == "oficial"
    assert T.norm_body_py("da Primeira  Câmara Cível") == "da 1a camara civel"
    assert column(spark, "da Primeira Câmara Cível, primeira vez", T.norm_body) == "da 1a camara civel, primeira vez"


def test_fold_in_place_keeps_places():
    raw = "Ação nº 1 — “ﬁm”\tß…"
    assert len(T.fold_in_place(raw)) == len(raw)
    assert T.matching_form("nº 1, Ação!") == "no 1 acao"


def test_html_to_text(spark):
    page = "<style>p{}</style><p>a&#19;b &amp;  c</p><script>x='</p>'</script>d<br>e&nbsp;f"
    assert T.html_to_text_py(page) == "a–b & c\n d\ne f"
    assert column(spark, page, T.html_to_text) == "a–b & c\n d\ne f"
    assert T.html_to_text_py("&eacute;") == "é"


@pytest.mark.parametrize("raw, day", [("Aracaju, 31 de Agosto de 2026.", dt.date(2026, 8, 31)), ("1º de março de 2020", dt.date(2020, 3, 1)), ("31 de fevereiro de 2026", None), ("31 de brumário de 2026", None)])
def test_long_date(spark, raw, day):
    assert T.long_date_py(raw) == day
    assert column(spark, raw, T.long_date) == day


def test_small_formatters(spark):
    assert column(spark, None, lambda c: T.short_date(c.cast("date"))) == "?"
    assert column(spark, "2026-08-31", lambda c: T.short_date(c.cast("date"))) == "31/08/2026"
    assert column(spark, "MARIA DA  SILVA E souza", T.proper_name) == "Maria da Silva e Souza"
    assert column(spark, "Tema 7/STJ", T.base_ref) == "Tema 7"
    assert column(spark, "0.9.10", lambda c: T.newer_version(c, F.lit("0.9.9"))) is True
    assert column(spark, "x", lambda c: T.newer_version(c, F.lit("0.9.9"))) is False
    assert column(spark, "1ª CÂMARA", lambda c: T.ascii_like(c, "câmara")) is False
    assert column(spark, "50%_x", lambda c: T.ascii_like(c, "%_X")) is True
    assert T.latin1_quoted("ação") == "a%E7%E3o"
    assert T.given_date("31/08/2026", "d") == T.given_date("2026-08-31", "d")
    with pytest.raises(ValueError):
        T.given_date("31/02/2026", "d")


@pytest.mark.parametrize(
    "word, forms",
    [("acao", ["acao", "acoes", "acaos", "acaes"]), ("morais", ["morais", "moral"]), ("moral", ["moral", "morais"]), ("pais", ["pais"]), ("casa", ["casa", "casas"]), ("dos", ["dos"]), ("bens", ["bens", "bem"]), ("a1bc", ["a1bc"])],
)
def test_number_variants(word, forms):
    assert Q.number_variants(word) == forms


def test_phrases_are_bounded():
    assert len(Q.phrases_of("danos morais materiais coletivos individuais homogeneos")) <= Q.MOST_PHRASES
    assert [str(p) for p in Q.phrases_of("consum$")] == ['"consum"*']
    assert [str(p) for p in Q.phrases_of("R$")] == ['"r"', ][:1]
    assert Q.phrases_of("...") == ()


def test_expressions():
    assert str(Q.parse('"plano de saúde" negativa')) == '"plano de saude" AND ("negativa" OR "negativas")'
    assert str(Q.parse(None, [["dano moral", "abalo"], ["banco"]], exact=True)) == '("dano moral" OR "abalo") AND "banco"'
    parsed = Q.parse("o dano da casa")
    assert parsed.ignored == ("o", "da") and [u.label for u in parsed.units] == ["dano", "casa"] and not parsed.required
    assert all(u.required for u in Q.parse("dano casa", exact=True).units)


@pytest.mark.parametrize("text, groups", [("dano OU moral", None), ("de da do", None), (None, [["..."]]), ("a NEAR b", None)])
def test_refusals(text, groups):
    with pytest.raises(Q.Refused):
        Q.parse(text, groups)


def test_hostile_texts_stay_phrases():
    for text in ('a"b" OR* (', "x' ; drop", 'NEAR("', "col:val", "^abc", "- -", "{a b}"):
        try:
            for phrase in Q.parse(text).phrases():
                assert all(w.isalnum() for w in phrase.words)
        except Q.Refused:
            pass


def test_query_options():
    assert [Q.page_size(n) for n in (1, 5, 6, 10, 11, 99)] == [5, 5, 10, 10, 20, 20] and Q.page_size(5, triage=True) == 30
    assert Q.fields_of("Tese; questao", ("tese", "questao")) == ("tese", "questao") and Q.fields_of(" ", ()) == () == Q.fields_of("tudo", ())
    with pytest.raises(Q.Refused):
        Q.fields_of("nada", ("tese",))
    assert Q.case_number("2026.6743") == "20266743"
    with pytest.raises(Q.Refused):
        Q.case_number("1234567890")


def test_enriched():
    groups = [["dano"], ["banco"]]
    assert Q.enriched(groups, 0, ["Dano", "abalo", "ABALO"]) == [["dano", "abalo"], ["banco"]] and groups == [["dano"], ["banco"]]
