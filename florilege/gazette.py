"""Invented gazettes made of the documents table, and the queries that parse and check them against what they were made of.

A document's text, letters alone, is the body of a decision: whole, whatever its length. What is put around it follows from
its number, so SQL can say what the parsers and checks should find."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import text as T
from florilege.operators import analytics, graph, index, parsers, retrieval, scratch, search, verify
from florilege.plans.query import Parsed, parse
from florilege.sources import bulletin
from florilege.streaming import sections

#: How decisions end, and the outcome that each says.
ENDINGS = (
    ("Recurso desprovido.", "desprovido"),
    ("Recurso provido.", "provido"),
    ("Recurso parcialmente provido.", "parcialmente provido"),
    ("Recurso não conhecido.", "não conhecido"),
    ("Negou provimento ao recurso.", "desprovido"),
    ("Recurso provido; apelo adesivo desprovido.", None),
)
BODY_SQL = "trim(regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g'))"


def body(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]+", " "))


def spelled(template: str, **columns: Column) -> Column:
    """A template with `{name}` where columns go."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def picked(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def picked_sql(values: tuple, n: str) -> str:
    return "(CASE " + n + f" % {len(values)} " + " ".join(f"WHEN {k} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for k, v in enumerate(values)) + " END)"


def documents(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """n, body. `dealt` out by number before bodies are made: files of few row groups are read by as many tasks."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("n"), "text")
    return (rows.repartition("n") if dealt else rows).select("n", body(F.col("text")).alias("body"))


# ---- structured abstracts ------------------------------------------------------------------------------------------------

STRUCTURED = (
    "RESUMO {n}. I. CASO EM EXAME 1. Recurso {n}. II. QUESTÃO EM DISCUSSÃO: 2. Saber {n}. III. RAZÕES DE DECIDIR 3. O dispositivo legal {body}. IV. DISPOSITIVO E TESE 4. {ending} "
    "Tese de julgamento: a regra {n}. Dispositivos relevantes citados: CC, art. {n}. Jurisprudência relevante citada: TJSE, processo {case}; STJ, Súmula {sumula}; Tema 1.0{tema}."
)
PLAIN = "SEM PARTES {n}. O dispositivo {body} Súmula Vinculante {sumula}; contrato {case}. {ending}"
MADE_SQL = (
    f"m AS (SELECT doc_id AS n, {BODY_SQL} AS body, doc_id % 3 = 1 AS plain, 202400000000 + doc_id % 7 AS \"case\", doc_id % 5 + 1 AS sumula, doc_id % 11 + 10 AS tema, "
    f"{picked_sql(tuple(e for e, _ in ENDINGS), 'doc_id')} AS ending FROM documents)"
)


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n, abstract: two in three structured."""
    rows, n = documents(spark, sf_dir), F.col("n")
    columns = {"n": n, "body": F.col("body"), "case": 202_400_000_000 + n % 7, "sumula": n % 5 + 1, "tema": n % 11 + 10, "ending": picked(tuple(e for e, _ in ENDINGS), n)}
    return rows.select("n", F.when(n % 3 == 1, spelled(PLAIN, **columns)).otherwise(spelled(STRUCTURED, **columns)).alias("abstract"))


PARTS_SQL = (
    f"WITH {MADE_SQL}, parts AS (SELECT n AS doc_id, n % 12 AS issue, "
    "CASE WHEN plain THEN 'SEM PARTES ' || n || '. O dispositivo ' || body || ' Súmula Vinculante ' || sumula || '; contrato ' || \"case\" || '. ' || rtrim(ending, '.') ELSE 'RESUMO ' || n || '. I' END AS cabecalho, "
    "CASE WHEN plain THEN '' ELSE '1. Recurso ' || n || '. II.' END AS caso, CASE WHEN plain THEN '' ELSE '2. Saber ' || n || '. III.' END AS questao, "
    "CASE WHEN plain THEN '' ELSE '3. O dispositivo legal ' || body || '. IV.' END AS razoes, CASE WHEN plain THEN '' ELSE '4. ' || ending END AS dispositivo, "
    "CASE WHEN plain THEN '' ELSE 'a regra ' || n || '.' END AS tese, CASE WHEN plain THEN '' ELSE 'CC, art. ' || n || '.' END AS legislacao, "
    "CASE WHEN plain THEN '' ELSE 'TJSE, processo ' || \"case\" || '; STJ, Súmula ' || sumula || '; Tema 1.0' || tema || '.' END AS juris_citada FROM m) "
)


def abstract_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.with_fields(decisions(spark, sf_dir), "abstract").select(F.col("n").alias("doc_id"), *parsers.FIELDS)


ABSTRACT_PARTS_SQL = PARTS_SQL + "SELECT * EXCLUDE (issue) FROM parts"
EDGES_SQL = (
    f"WITH {MADE_SQL}, e AS (SELECT n::VARCHAR AS source, unnest(CASE WHEN plain THEN [{{'k': 'qualificado', 'r': 'Súmula Vinculante ' || sumula}}] "
    "ELSE [{'k': 'qualificado', 'r': 'Súmula ' || sumula || '/STJ'}, {'k': 'qualificado', 'r': 'Tema 10' || tema}, {'k': 'tjse', 'r': \"case\"::VARCHAR}] END) AS u FROM m), "
    "edges AS (SELECT source, u.k AS kind, u.r AS ref FROM e) "
)


def anchor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.edges(decisions(spark, sf_dir), "n", "abstract")


ANCHOR_EDGES_SQL = EDGES_SQL + "SELECT source, kind, ref FROM edges"


def base_ref_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_cited(anchor_edges(spark, sf_dir), "qualificado", 10, merge=True)


BASE_REF_MERGE_SQL = EDGES_SQL + "SELECT max(ref) AS ref, count(DISTINCT source) AS citing FROM edges WHERE kind = 'qualificado' GROUP BY split_part(ref, '/', 1) ORDER BY citing DESC, ref LIMIT 10"


def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).select(F.col("n").alias("doc_id"), analytics.outcome(T.norm(F.col("abstract"))).alias("outcome"))


OUTCOME_SQL = f"SELECT doc_id, {picked_sql(tuple(o for _, o in ENDINGS), 'doc_id')} AS outcome FROM documents"
COURTS = ("1ª Câmara Cível", "2ª Câmara Cível", "Câmara Criminal")


def panorama_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decisions(spark, sf_dir).withColumn("body", picked(COURTS, F.col("n")))
    anchors = F.regexp_extract_all("abstract", F.lit(r"Tema 1\.0\d\d"), F.lit(0))
    return analytics.panorama(rows, [F.desc("n")], T.norm(F.col("abstract")), anchors, ["body"])


PANORAMA_SQL = (
    f"WITH r AS (SELECT doc_id AS n, coalesce({picked_sql(tuple(o for _, o in ENDINGS), 'doc_id')}, '{analytics.OUTCOMES[-1]}') AS outcome, {picked_sql(COURTS, 'doc_id')} AS body, "
    f"CASE WHEN doc_id % 3 <> 1 THEN 'Tema 1.0' || (doc_id % 11 + 10) END AS anchor FROM documents ORDER BY doc_id DESC LIMIT {analytics.TOP_ROWS}), "
    "c AS (SELECT 'outcome' AS facet, outcome AS value, count(*) AS n FROM r GROUP BY outcome UNION ALL SELECT 'body', body, count(*) FROM r GROUP BY body "
    "UNION ALL SELECT 'anchor', anchor, count(*) FROM r WHERE anchor IS NOT NULL GROUP BY anchor HAVING count(*) >= 2) "
    "SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS k FROM c) WHERE k <= CASE facet WHEN 'anchor' THEN 8 ELSE 6 END"
)


def field_search(spark: SparkSession, sf_dir: str, query: Parsed, scoring: search.Scoring) -> DataFrame:
    parts = abstract_parts(spark, sf_dir).withColumn("issue", F.col("doc_id") % 12)
    built = index.build_index(parts, parsers.SEARCHABLE)
    return search.scored(built, query, scoring).select("doc_id", F.col("coverage").cast("int").alias("coverage"), F.round("score", 6).alias("score"))


# ---- requests --------------------------------------------------------------------------------------------------------------

CLASSES, REPORTER_NAMES = ("Apelação", "Agravo", "Embargos", "Mandado"), ("DES. ANA", "DES. BETO", "DES. CAIO")
WIDE, NARROW = retrieval.Request(text="dispositivo saber"), retrieval.Request(text="heed")


def request_tables(spark: SparkSession, sf_dir: str) -> retrieval.Tables:
    """The tables of the search entry, of all documents."""
    n = F.col("n")
    rows = decisions(spark, sf_dir).select(
        n.cast("string").alias("decision"), (202_400_000_000 + n % 7).cast("string").alias("process"), picked(CLASSES, n).alias("class"), picked(REPORTER_NAMES, n).alias("rapporteur"),
        picked(COURTS, n).alias("body"), (n % 12).cast("int").alias("issue"), F.date_add(F.lit("2026-01-01").cast("date"), (n % 12).cast("int")).alias("date"), "abstract",
    )
    source, none = f"{sf_dir}/documents.parquet", spark.range(0)
    whole = scratch.once(spark, source, lambda: index.build_index(rows, tuple(retrieval.WEIGHTS)), "requests")
    edges = scratch.once(spark, source, lambda: anchor_edges(spark, sf_dir), "edges")
    return retrieval.Tables(
        whole, none, edges, none.selectExpr("cast(id AS string) AS decision", "1 AS issue"), none.selectExpr("cast(id AS string) AS decision")
    )


def answered_panorama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*retrieval.answer(request_tables(spark, sf_dir), WIDE).panorama], "facet string, value string, n long")


def answered_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.answer(request_tables(spark, sf_dir), NARROW).hints
    return spark.createDataFrame([*found], "term string, df long, lift double").withColumn("lift", F.round("lift", 6))


#: The decisions as one table, their pads, and which endings and precedents they have.
REQUEST_SQL = (
    f"{MADE_SQL}, w AS (SELECT n, n::VARCHAR AS decision, n % 12 AS issue, {picked_sql(CLASSES, 'n')} AS class, {picked_sql(REPORTER_NAMES, 'n')} AS rapporteur, {picked_sql(COURTS, 'n')} AS body, "
    f"coalesce({picked_sql(tuple(o for _, o in ENDINGS), 'n')}, '{analytics.OUTCOMES[-1]}') AS outcome, "
    "CASE WHEN plain THEN ['Súmula Vinculante ' || sumula] ELSE ['Súmula ' || sumula || '/STJ', 'Tema 10' || tema] END AS anchors, "
    "CASE WHEN plain THEN 'SEM PARTES ' || n || '. O dispositivo ' || body || ' Súmula Vinculante ' || sumula || '; contrato ' || \"case\" || '. ' || ending "
    "ELSE 'RESUMO ' || n || '. I. CASO EM EXAME 1. Recurso ' || n || '. II. QUESTÃO EM DISCUSSÃO: 2. Saber ' || n || '. III. RAZÕES DE DECIDIR 3. O dispositivo legal ' || body || '. IV. DISPOSITIVO E TESE 4. ' || "
    "ending || ' Tese de julgamento: a regra ' || n || '. Dispositivos relevantes citados: CC, art. ' || n || '. Jurisprudência relevante citada: TJSE, processo ' || \"case\" || '; STJ, Súmula ' || sumula || "
    "'; Tema 1.0' || tema || '.' END AS abstract FROM m)"
)


def best_sql(request: retrieval.Request, pads: str, scored_sql: Callable) -> str:
    """Common tables up to `best`, the first decisions by score alone."""
    tables = scored_sql(parse(request.text), retrieval.WEIGHTS, tuple(retrieval.WEIGHTS), f"{REQUEST_SQL}, {pads}")
    return f"{tables}, best AS (SELECT * FROM scored ORDER BY score, issue DESC, decision DESC LIMIT {analytics.TOP_ROWS}) "


FACETS_SQL = (
    ", c AS (SELECT 'outcome' AS facet, outcome AS value, count(*) AS n FROM best GROUP BY outcome UNION ALL SELECT 'body', body, count(*) FROM best GROUP BY body UNION ALL SELECT 'class', class, count(*) FROM best GROUP BY class "
    "UNION ALL SELECT 'anchor', a, count(*) FROM (SELECT unnest(anchors) AS a FROM best) GROUP BY a HAVING count(*) >= 2) "
    "SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS k FROM c) WHERE k <= CASE facet WHEN 'anchor' THEN 8 ELSE 6 END"
)


def hints_sql(request: retrieval.Request) -> str:
    excluded = ", ".join(f"'{w}'" for w in [*retrieval.USUAL_WORDS, *re.findall(retrieval.WORD, str(parse(request.text)))])
    pads = " || ".join(f"pad_{f}" for f in retrieval.WEIGHTS)
    return (
        f", d AS (SELECT t, count(*) AS df FROM (SELECT decision, unnest(list_distinct(regexp_extract_all(strip_accents(lower(abstract)), '{retrieval.WORD}'))) AS t FROM best) GROUP BY t), "
        f"v AS (SELECT t, count(DISTINCT decision) AS doc FROM (SELECT decision, unnest(string_split_regex(trim({pads}), ' +')) AS t FROM idx) GROUP BY t), "
        "b AS (SELECT count(*)::DOUBLE AS b, (SELECT count(*)::DOUBLE FROM idx) AS n FROM best), "
        "l AS (SELECT t, df, (df / b.b) / (greatest(coalesce(doc, 1), 1) / b.n) AS lift FROM d LEFT JOIN v USING (t), b "
        f"WHERE b.b >= {analytics.LEAST_ROWS} AND df >= greatest(4, floor(b.b * 0.06)) AND t NOT IN ({excluded})) "
        f"SELECT t AS term, df, round(lift, 6) AS lift FROM l WHERE lift >= {analytics.LEAST_LIFT} ORDER BY lift * sqrt(df) DESC, t DESC LIMIT {analytics.MOST_HINTS}"
    )


# ---- section pages ---------------------------------------------------------------------------------------------------------

#: Lines after a decision's link, and the label and name that they come to.
REPORTERS = (
    ("<div>RELATOR: DES. FULANO DE TAL</div>", "RELATOR", "DES. FULANO DE TAL"),
    (
        "<div>RELATORA ORIGINÁRIA: DES. ANA</div><div>RELATOR PARA O ACÓRDÃO: DES. BETO</div><div>DA SILVA</div>",
        "RELATOR PARA O ACÓRDÃO (há também RELATORA ORIGINÁRIA: DES. ANA)",
        "DES. BETO DA SILVA",
    ),
    ("<div>RELATOR: VAGA DE DESEMBARGADOR (G-21)</div><div>RELATOR CONVOCADO: DR. CAIO</div>", "RELATOR CONVOCADO (há também RELATOR: VAGA DE DESEMBARGADOR (G-21))", "DR. CAIO"),
    ("<div>RELATOR: CARGO VAGO</div>", "RELATOR (cargo vago)", "CARGO VAGO"),
    ("", "", ""),
)
CLASS_CELL = '<tr><td><font style="font-size: 10pt">Classe {class}</font></td></tr>'
DECISION_CELL = (
    '<tr><td><font>EMENTA: Sobre {n}<br>{body}</font><br>PROCESSO: <a href="relatorio.wsp?tmp.numprocesso={case}&amp;tmp.numacordao={n}">{case}</a><br><div>AC Nº {n}/2026</div>{lines}</td></tr>'
)


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """issue, code, page, html: sections of 50 decisions, five to a page; a class is named at every tenth and goes on over pages."""
    rows, n = documents(spark, sf_dir), F.col("n")
    cell = spelled(DECISION_CELL, n=n, body=F.col("body"), case=202_400_000_000 + n, lines=picked(tuple(r[0] for r in REPORTERS), n))
    head = F.when(n % 10 == 0, spelled(CLASS_CELL, **{"class": F.floor(n / 10) % 7})).otherwise(F.lit(""))
    cells = rows.select(F.floor(n / 50).cast("int").alias("issue"), F.lit(5).alias("code"), (F.floor(n % 50 / 5) + 1).cast("int").alias("page"), F.struct("n", F.concat(head, cell).alias("html")).alias("c"))
    # a page has five decisions
    pages = cells.groupBy("issue", "code", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["html"]), "").alias("html"))
    return pages.withColumn("html", F.concat(F.lit("<table>"), "html", F.lit("</table><!--<table>"), "html", F.lit("</table>-->")))


def section_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.section_rows(section_pages(spark, sf_dir), ["issue", "code"])


SECTION_SQL = (
    f"WITH d AS (SELECT doc_id AS n, doc_id // 50 AS issue, {BODY_SQL} AS body FROM documents) "
    "SELECT issue::INT AS issue, 5 AS code, n::VARCHAR AS decision, (202400000000 + n)::VARCHAR AS process, "
    "coalesce(last_value(CASE WHEN n % 10 = 0 THEN 'Classe ' || (n // 10 % 7) END IGNORE NULLS) OVER (PARTITION BY issue ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS class, "
    f"'AC Nº ' || n || '/2026' AS appeal, {picked_sql(tuple(r[2] for r in REPORTERS), 'n')} AS rapporteur, {picked_sql(tuple(r[1] for r in REPORTERS), 'n')} AS label, trim('Sobre ' || n || ' ' || body) AS abstract FROM d"
)


def packaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, from packages: how long it is, and its digest."""
    path = f"{scratch.root(spark)}/florilege/{uuid.uuid4().hex}-packages"
    bulletin.write_packages(section_pages(spark, sf_dir), path)
    return bulletin.pages(spark, path).select("issue", "code", "page", F.length("html").alias("n_chars"), F.md5("html").alias("md5"))


def streamed_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decisions of every page, from packages through the stream that keeps each section's state."""
    at = f"{scratch.root(spark)}/florilege/{uuid.uuid4().hex}"
    bulletin.write_packages(section_pages(spark, sf_dir), f"{at}-packages")
    stream = bulletin.registered(spark).readStream.format("bulletin").option("settle", 0).load(f"{at}-packages")
    sections.watch(stream, f"{at}-changes", f"{at}-checkpoint", [5], parts=spark.sparkContext.defaultParallelism).awaitTermination()
    return sections.current(spark, f"{at}-changes").filter("kind = 'item'").select("issue", "code", *sections.ITEM_NAMES)


def filled(template: str, **values: str) -> str:
    """A template as a SQL string, `{name}` as the SQL of that value."""
    return "'" + re.sub(r"\{(\w+)\}", lambda m: f"' || {values[m[1]]} || '", template.replace("'", "''")) + "'"


PACKAGED_SQL = (
    f"WITH d AS (SELECT doc_id AS n, {BODY_SQL} AS body FROM documents), c AS (SELECT n, (n // 50)::INT AS issue, (n % 50 // 5 + 1)::INT AS page, "
    f"(CASE WHEN n % 10 = 0 THEN {filled(CLASS_CELL, **{'class': '(n // 10 % 7)'})} ELSE '' END) || "
    f"{filled(DECISION_CELL, n='n', body='body', case='(202400000000 + n)', lines=picked_sql(tuple(r[0] for r in REPORTERS), 'n'))} AS cell FROM d), "
    "h AS (SELECT issue, page, string_agg(cell, '' ORDER BY n) AS cells FROM c GROUP BY issue, page), "
    "p AS (SELECT issue, page, '<table>' || cells || '</table><!--<table>' || cells || '</table>-->' AS html FROM h) "
    "SELECT issue, 5 AS code, page, length(html)::INT AS n_chars, md5(html) AS md5 FROM p"
)

# ---- full texts and quotations -----------------------------------------------------------------------------------------------

FULL_TEXT = (
    "<div>ACÓRDÃO: {n}</div><div>RECURSO: Apelação {n}</div><div>PROCESSO: {case}</div><div>RELATOR: DES. FULANO {n}</div><p>EMENTA</p><p>I. CASO EM EXAME 1. Apelação.</p>"
    "<p>ACÓRDÃO</p><p>Vistos, acordam os integrantes do Grupo 2 da {court} do Tribunal de Justiça do Estado de {state}, por unanimidade, negar provimento.</p>"
    "<p>Aracaju/SE, {day} de {month} de 2026.</p><p>RELATÓRIO</p><p>Sustenta a apelante que o contrato numero {n} excluia expressamente o tratamento pedido pela autora.</p>"
    "<p>VOTO</p><p>{body}.</p><p>A clausula numero {n} fixou com clareza o prazo de carencia aplicavel.</p><p>Não há prova de que o beneficiário numero {n} tenha sido informado do limite de cobertura.</p>"
    "<p>Como já se decidiu: “a operadora numero {n} responde pelos danos causados ao consumidor em caso de recusa indevida”.</p>"
    "<p>Ainda que assim não fosse, o prazo contratual numero {n} de carência já estava vencido na data do pedido.</p>"
    "<p>Precedentes: Apelação cível. Recusa injustificada numero {n} de cobertura configura dano moral. (TJ-MG - AC 123, Rel. Des. Beltrano)</p>"
    "<p>Ante o exposto, nego provimento ao recurso numero {n}, que trata de consumo, e mantenho integralmente a sentença recorrida.</p>"
)
MONTHS = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro")
STATES = ("Sergipe", "Sergipe", "Sergipe", "Sergipe", "Minas Gerais")
WRITTEN = ("Primeira Câmara Cível", "2ª Câmara Cível", "Câmara Criminal")
#: A quotation of the text, what it is labelled, where it stands, and whether it is there at all.
QUOTATIONS = (
    ("A cláusula número {n} fixou com clareza o prazo de carência", "", "reasoning", True),
    ("o contrato numero {n} excluia expressamente o tratamento pedido", "claim", "report", True),
    ("a operadora numero {n} responde pelos danos causados ao consumidor", "quoted", "reasoning", True),
    ("o prazo contratual numero {n} de carência já estava vencido", "obiter", "reasoning", True),
    ("Recusa injustificada numero {n} de cobertura configura dano moral", "transcribed", "reasoning", True),
    ("prova de que o beneficiário numero {n} tenha sido informado", "negated", "reasoning", True),
    ("mantenho integralmente a sentença recorrida", "", "dispositive", True),
    ("a cláusula numero {n} fixou com clareza [...] informado do limite de cobertura", "", "reasoning", True),
    ("isto sobre o recurso numero {n} não está escrito em parte alguma", "", "", False),
)


def full_pages(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """n, html."""
    rows, n = documents(spark, sf_dir, dealt), F.col("n")
    columns = {"n": n, "body": F.col("body"), "case": 202_400_000_000 + n, "court": picked(WRITTEN, n), "state": picked(STATES, n), "day": n % 28 + 1, "month": picked(MONTHS, n)}
    return rows.select("n", spelled(FULL_TEXT, **columns).alias("html"))


def full_text_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parsers.full_texts(full_pages(spark, sf_dir), "n", "html")
    return found.select(F.col("n").alias("doc_id"), "decision", "appeal", "process", "rapporteur", "cut", "body", "ambiguous", "judged", (F.col("start") > 0).alias("headed"), F.md5("text").alias("digest"))


FULL_TEXT_SQL = (
    f"WITH d AS (SELECT doc_id AS n, {BODY_SQL} AS body, {picked_sql(STATES, 'doc_id')} AS state FROM documents), t AS (SELECT *, "
    + "'"
    + FULL_TEXT.replace("<div>", "").replace("<p>", "").replace("</div>", "\n").replace("</p>", "\n").replace("'", "''").removesuffix("\n")
    .replace("{n}", "' || n || '").replace("{body}", "' || body || '").replace("{case}", "' || (202400000000 + n) || '").replace("{court}", "' || " + picked_sql(WRITTEN, "n") + " || '")
    .replace("{state}", "' || state || '").replace("{day}", "' || (n % 28 + 1) || '").replace("{month}", "' || " + picked_sql(MONTHS, "n") + " || '")
    + "' AS text FROM d) "
    "SELECT n AS doc_id, n::VARCHAR AS decision, 'Apelação ' || n AS appeal, (202400000000 + n)::VARCHAR AS process, 'DES. FULANO ' || n AS rapporteur, true AS cut, "
    f"CASE WHEN state = 'Sergipe' THEN {picked_sql(COURTS, 'n')} END AS body, false AS ambiguous, CASE WHEN state = 'Sergipe' THEN make_date(2026, (n % 12 + 1)::INT, (n % 28 + 1)::INT) END AS judged, "
    "true AS headed, md5(text) AS digest FROM t"
)


def quotation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's decision of the state, with each of the quotations."""
    home = full_pages(spark, sf_dir, dealt=True).filter(picked(STATES, F.col("n")) == STATES[0])
    texts = parsers.full_texts(home, "n", "html").select("n", F.expr("substring(text, start + 1)").alias("text"))
    each = F.array(*(spelled(t, n=F.col("n")) for t, *_ in QUOTATIONS))
    found = verify.verify_each(texts.withColumn("quotations", each), ["n"], "text", "quotations")
    return found.select(F.col("n").alias("doc_id"), "kind", "ok", F.array_join("labels", ",").alias("labels"), "position")


QUOTATION_SQL = (
    f"SELECT doc_id, kind::INT AS kind, {picked_sql(tuple('t' if q[3] else 'f' for q in QUOTATIONS), 'kind')} = 't' AS ok, {picked_sql(tuple(q[1] for q in QUOTATIONS), 'kind')} AS labels, "
    f"{picked_sql(tuple(q[2] for q in QUOTATIONS), 'kind')} AS position FROM documents, range({len(QUOTATIONS)}) AS k(kind) WHERE {picked_sql(STATES, 'doc_id')} = 'Sergipe'"
)
