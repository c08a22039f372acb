"""The search entry: one request with its words, filters, order and page, over the tables of an index.

Nothing is left of a request when it is answered: a page is a few rows, which are fetched, and no rows are kept for later."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from florilege.functions import text as T
from florilege.operators import analytics, graph, parsers, search
from florilege.operators import index as index_of
from florilege.plans.query import Parsed, Refused, case_number, fields_of, page_size, parse

#: Weights of a search in whole decisions.
WEIGHTS = {"abstract": 5.0, "class": 2.0, "rapporteur": 1.0}
SNIPPET, PANORAMA_FROM, ALL_UNITS_MOST = 900, 5, 8
PANORAMA_ANCHORS = 12
#: Words of every abstract, which hint at nothing.
USUAL_WORDS = (
    "recurso conhecido provido desprovido acordao decisao agravo apelacao relator camara civel interposto contra embargos direito processual civil ementa turma tribunal justica "
    "sergipe tese julgamento unanimidade unanime votos voto dispositivo relevantes citados jurisprudencia constituicao federal codigo artigo artigos casos exame razoes decidir "
    "questao discussao apelante apelado agravante agravado recorrente recorrido sentenca juizo primeiro grau parte partes"
).split()
WORD = "[a-z]{5,}"


@dataclass(frozen=True)
class Request:
    """`text` free words and quotes, `groups` ORs joined by AND; filters; then order, page and form of the answer."""

    text: str | None = None
    groups: list[list[str]] | None = None
    body: str | None = None
    class_name: str | None = None
    rapporteur: str | None = None
    number: str | None = None
    size: int = 10
    page: int = 1
    first_date: str | None = None
    last_date: str | None = None
    order: str = "relevant"
    exact: bool = False
    fields: str = "tudo"
    cites: str | None = None
    triage: bool = False


@dataclass(frozen=True)
class Tables:
    """`whole`: decision, process, class, rapporteur, body, issue, date, abstract, with pads of WEIGHTS; `parts`: decision and pads of the
    abstract's parts; edges (source, kind, ref); republications (decision, issue); receipts (decision)."""

    whole: DataFrame
    parts: DataFrame
    edges: DataFrame
    republications: DataFrame
    receipts: DataFrame
    #: term, doc (rows of `whole` that have it); made from `whole` where it is not at hand.
    vocabulary: DataFrame | None = None


@dataclass(frozen=True)
class Answer:
    outcome: search.Outcome
    order: str
    ignored: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    matching_all: int | None = None
    panorama: tuple[tuple[str, str, int], ...] = ()
    hints: tuple[tuple[str, int, float], ...] = ()


def filters_of(request: Request) -> tuple[Column | None, dict]:
    """The conditions on a decision's own columns, and the filters that were given."""
    first = T.given_date(request.first_date, "first_date") if request.first_date else None
    last = T.given_date(request.last_date, "last_date") if request.last_date else None
    given = {k: getattr(request, k) for k in ("body", "class_name", "rapporteur", "number", "first_date", "last_date", "cites") if getattr(request, k)}
    parts = [T.ascii_like(F.col(c), value) for c, value in (("body", request.body), ("class", request.class_name), ("rapporteur", request.rapporteur)) if value]
    if request.number:
        number = case_number(request.number)
        parts.append((F.col("decision") == number) | (F.col("process") == number))
    if first or last:
        parts.append(search.in_dates(F.col("date"), first, last))
    return (search.all_of(parts) if parts else None), given


def answer(tables: Tables, request: Request) -> Answer:
    if request.order not in ("relevant", "newest", "oldest"):
        raise Refused(f"unknown order {request.order!r}")
    query = parse(request.text, request.groups, request.exact) if request.text or request.groups else Parsed(())
    if not query.units and not request.number and not request.cites:
        raise Refused("give words, groups, a number or a reference")
    asked = fields_of(request.fields, parsers.SEARCHABLE)
    where, given = filters_of(request)
    reference = parsers.reference(request.cites) if request.cites else None
    if request.cites and reference is None:
        raise Refused(f"{request.cites!r} is not a reference that the graph knows")
    own = tables.whole.drop(*(c for c in tables.whole.columns if c.startswith("pad_") or c == "n_tokens"))
    index, scoring = tables.whole, search.Scoring(WEIGHTS)
    if asked:
        index, scoring = tables.parts.join(own, "decision"), search.field_scoring(asked, parsers.FIELD_WEIGHTS, "cabecalho")
    rows = search.scored(index, query, scoring) if query.units else own.withColumns({"coverage": F.lit(0), "score": F.lit(0.0)})
    kept = rows.filter(where) if where is not None else rows
    if reference:
        kept = search.citing_filter(kept, "decision", tables.edges, *reference)
    order = request.order if query.units or request.order != "relevant" else "newest"  # without words there is no relevance
    way = F.asc if order == "oldest" else F.desc
    by = search.ranked(kept, query, "issue", "decision") if order == "relevant" else [way("issue"), way("decision")]
    size, number = page_size(request.size, request.triage), max(1, request.page)
    optional = len(query.optional)
    total, full = kept.agg(F.count("*"), F.count_if(F.col("coverage") == optional)).first()
    last = -(-total // size)
    told = {"order": order, "ignored": query.ignored, "filters": given}
    if not total:
        unfiltered = rows.count() if given and query.units else 0
        # units are counted in whole decisions, whatever fields were asked for
        why = tuple(map(tuple, search.zero_diagnosis(tables.whole, query, tuple(WEIGHTS)).collect())) if query.units else ()
        return Answer(search.Outcome("empty", 0, None, 0, unfiltered, why), **told)
    if number > last:
        return Answer(search.Outcome("beyond", total, None, last), **told)
    if request.triage:
        page = search.triage(kept, "abstract", by, number)
        return Answer(search.Outcome("rows", total, fetched(page), last), **told)
    page = decorated(tables, fetched(search.page(kept, by, size, number)), query)
    view, hints = overview(tables, kept, query, order) if number == 1 and total >= PANORAMA_FROM else ((), ())
    all_units = full if order == "relevant" and 1 < optional <= ALL_UNITS_MOST else None
    return Answer(search.Outcome("rows", total, page.orderBy("place").drop("place"), last), **told, matching_all=all_units, panorama=view, hints=hints)


def overview(tables: Tables, kept: DataFrame, query: Parsed, order: str) -> tuple[tuple, tuple]:
    """Facets, and words that tell these decisions from the rest, of the best by score alone, whatever leads the page; or of the newest."""
    by = [*([F.asc("score")] if order == "relevant" else []), F.desc("issue"), F.desc("decision")]
    anchors = F.udf(lambda text: parsers.anchors(text, PANORAMA_ANCHORS), "array<string>", useArrow=True)  # over the rows of a panorama
    norm = T.norm(F.col("abstract"))
    view = analytics.panorama(kept, by, norm, anchors("abstract"), ["body", "class"]).collect()
    best = kept.orderBy(*by).limit(analytics.TOP_ROWS)
    excluded = [*USUAL_WORDS, *re.findall(WORD, str(query))]
    vocabulary = tables.vocabulary if tables.vocabulary is not None else index_of.vocabulary(tables.whole, tuple(WEIGHTS))
    hints = analytics.lift_terms(best, F.regexp_extract_all(norm, F.lit(WORD), F.lit(0)), vocabulary, tables.whole.count(), excluded).collect()
    return tuple(map(tuple, view)), tuple(map(tuple, hints))


def fetched(page: DataFrame) -> DataFrame:
    """A page's rows, 30 at most, with their place in it."""
    rows = page.collect()
    schema = StructType([*page.schema.fields, StructField("place", IntegerType())])
    return page.sparkSession.createDataFrame([(*r, n) for n, r in enumerate(rows, 1)], schema)


def decorated(tables: Tables, page: DataFrame, query: Parsed) -> DataFrame:
    """A page with what is known of each decision: where its snippet is, what it cites and who cites it, its case's other decisions."""
    terms = [" ".join(p.words) for u in query.units for p in u.phrases[:1]] or [""]
    cut = F.when(F.length("abstract") <= SNIPPET, F.col("abstract")).otherwise(search.snippet(F.col("abstract"), T.norm(F.col("abstract")), terms))
    cited = graph.in_degree(tables.edges.filter("kind = 'tjse'").join(page.select(F.col("process").alias("ref")).distinct(), "ref", "left_semi"))
    out = analytics.decorated(page.withColumn("abstract", cut), "decision", "process", tables.republications.join(page.select("decision"), "decision", "left_semi"), cited, tables.receipts)
    own = tables.edges.join(page.select(F.col("decision").alias("source")), "source", "left_semi").groupBy(F.col("source").alias("decision")).agg(F.sort_array(F.collect_set("ref")).alias("cites"))
    case = tables.whole.select("process", "decision").join(page.select("process").distinct(), "process", "left_semi")
    others = graph.siblings(case, "process", "decision").join(page.select("decision"), "decision", "left_semi")
    return out.join(own, "decision", "left").join(others, "decision", "left")
