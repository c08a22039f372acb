"""The engine's queries over the test tables, each with the SQL that says the same.

`q` registers a query under its function's name with its SQL, or without one where SQL cannot say it."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege import gazette
from florilege.functions import text as T
from florilege.operators import analytics, evaluate, graph, index, merge, parsers, postings, retrieval, scratch, search, store, verify
from florilege.plans.query import Parsed, Phrase, parse
from florilege.streaming import admission

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FIELDS = ("text", "lang", "source")
WEIGHTS = search.Scoring({"text": 5.0, "lang": 2.0, "source": 1.0})


def corpus(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """The index of the documents, written once a session and searched from there."""

    def build() -> DataFrame:
        docs = table(spark, sf_dir, "documents").withColumn("issue", (F.col("doc_id") % 12).cast("int"))
        return index.build_index(docs, fields).drop(*(f for f in ("text",)))

    return scratch.once(spark, f"{sf_dir}/documents.parquet", build, fields)


# ---- SQL twins ------------------------------------------------------------------------------------------------------

FOLD = "strip_accents(lower(coalesce({0}, '')))"
PAD = "(' ' || trim(regexp_replace(" + FOLD + ", '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+', '  ', 'g')) || ' ')"
COUNT = "(CASE WHEN length({0}) > 2 THEN (length({0}) - length(replace({0}, '  ', ''))) // 2 + 1 ELSE 0 END)"


def idx(fields: tuple[str, ...] = ("text",)) -> str:
    pads = ", ".join(f"{PAD.format(f)} AS pad_{f}" for f in fields)
    sizes = " + ".join(COUNT.format(f"pad_{f}") for f in fields)
    return f"p AS (SELECT doc_id, lang, source, doc_id % 12 AS issue, {pads} FROM documents), idx AS (SELECT *, {sizes} AS n_tokens FROM p)"


def occ(phrase: Phrase, field: str) -> str:
    s = search.needle(phrase)
    return f"((length(pad_{field}) - length(replace(pad_{field}, '{s}', ''))) // {len(s)})"


def has(phrase: Phrase, field: str) -> str:
    return f"contains(pad_{field}, '{search.needle(phrase)}')"


def unit_sql(unit, fields=("text",)) -> str:
    return "(" + " OR ".join(has(p, f) for p in unit.phrases for f in fields) + ")"


def match_sql(query: Parsed, fields=("text",)) -> str:
    parts = [unit_sql(u, fields) for u in query.required]
    if query.optional:
        parts.append("(" + " OR ".join(unit_sql(u, fields) for u in query.optional) + ")")
    return " AND ".join(parts)


def bm25_sql(query: Parsed, weights: dict[str, float], fields=("text",), base: str = "") -> str:
    """idx, stats and `scored` (all columns of idx, coverage, score) as common tables."""
    phrases, used = query.phrases(), [f for f, w in weights.items() if w > 0]
    f = [" + ".join(f"{weights[k]}::DOUBLE * {occ(p, k)}" for k in used) for p in phrases]
    counts = ", ".join(f"count(*) FILTER ({' OR '.join(has(p, k) for k in used)}) AS n{i}" for i, p in enumerate(phrases))
    idf = [f"(SELECT CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END FROM s)" for i in range(len(phrases))]
    terms = " ".join(f"- {idf[i]} * ({f[i]}) * 2.2::DOUBLE / (({f[i]}) + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_tokens / (SELECT m FROM s)))" for i in range(len(phrases)))
    coverage = " + ".join(f"{unit_sql(u, used)}::INT" for u in query.optional) or "0"
    return f"WITH {base or idx(fields)}, s AS (SELECT count(*)::DOUBLE AS n, avg(n_tokens) AS m, {counts} FROM idx), scored AS (SELECT *, {coverage} AS coverage, 0 {terms} AS score FROM idx WHERE {match_sql(query, used)})"


# ---- ranked retrieval ---------------------------------------------------------------------------------------------------

FREE, GROUPS, ONE = parse("tion heed edon with"), parse(None, [["with", "from"], ["heed*", "reed"], ["the of"]]), Parsed(parse("with").units)
PHRASED = parse('"the of" heed')


def rounded(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("coverage").cast("int").alias("coverage"), F.round("score", 6).alias("score"))


def top(rows: DataFrame, query: Parsed, k: int = 10) -> DataFrame:
    return rounded(search.page(rows, search.ranked(rows, query, "issue", "doc_id"), k))


ORDER = "ORDER BY {0} score, issue DESC, doc_id::VARCHAR DESC"
PICK = "SELECT doc_id, coverage::INT AS coverage, round(score, 6) AS score FROM scored "


@q(bm25_sql(FREE, {"text": 5.0}) + PICK + ORDER.format("coverage DESC,") + " LIMIT 10")
def coverage_rank_topk(spark, sf_dir):
    rows = search.scored(corpus(spark, sf_dir), FREE, search.Scoring({"text": 5.0}))
    return top(rows, FREE)


@q(bm25_sql(ONE, {"text": 1.0}) + PICK)
def bm25_single(spark, sf_dir):
    return rounded(search.scored(corpus(spark, sf_dir), ONE, search.Scoring({"text": 1.0})))


FIELD_QUERY = parse("src3 heed en")


@q(bm25_sql(FIELD_QUERY, WEIGHTS.weights, FIELDS) + PICK)
def bm25_fields(spark, sf_dir):
    return rounded(search.scored(corpus(spark, sf_dir, FIELDS), FIELD_QUERY, WEIGHTS))


@q(bm25_sql(FIELD_QUERY, {"text": 0.0, "lang": 3.0, "source": 0.5}, FIELDS) + PICK)
def bm25_column_filter(spark, sf_dir):
    return rounded(search.scored(corpus(spark, sf_dir, FIELDS), FIELD_QUERY, search.Scoring({"text": 0.0, "lang": 3.0, "source": 0.5})))


@q(bm25_sql(GROUPS, {"text": 5.0}) + PICK + ORDER.format("") + " LIMIT 20")
def grouped_search(spark, sf_dir):
    return top(search.scored(corpus(spark, sf_dir), GROUPS, search.Scoring({"text": 5.0})), GROUPS, 20)


@q(bm25_sql(PHRASED, {"text": 5.0}) + PICK + ORDER.format("") + " LIMIT 10 OFFSET 10")
def page_offset(spark, sf_dir):
    rows = search.scored(corpus(spark, sf_dir), PHRASED, search.Scoring({"text": 5.0}))
    return rounded(search.page(rows, search.ranked(rows, PHRASED, "issue", "doc_id"), 10, 2))


PREFIX = Phrase(("heed",), True)


@q(f"WITH {idx()} SELECT doc_id, {occ(PREFIX, 'text')}::INT AS n FROM idx WHERE {has(PREFIX, 'text')}")
def prefix_match(spark, sf_dir):
    pad = F.col("pad_text")
    return corpus(spark, sf_dir).filter(search.has(pad, PREFIX)).select("doc_id", search.occurrences(pad, PREFIX).alias("n"))


COUNTED = (Phrase(("the", "of")), Phrase(("ing", "and")), Phrase(("de",)), Phrase(("thr",), True))


@q(f"WITH {idx()} SELECT doc_id, " + ", ".join(f"{occ(p, 'text')}::INT AS p{i}" for i, p in enumerate(COUNTED)) + ", n_tokens FROM idx")
def phrase_match_counts(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", *(search.occurrences(F.col("pad_text"), p).alias(f"p{i}") for i, p in enumerate(COUNTED)), "n_tokens")


PLURAL = parse("heor ingand tional")


@q(f"WITH {idx()} SELECT doc_id, " + ", ".join(f"{unit_sql(u)} AS u{i}" for i, u in enumerate(PLURAL.units)) + f" FROM idx WHERE {match_sql(PLURAL)}")
def plural_expanded_search(spark, sf_dir):
    found = corpus(spark, sf_dir).filter(search.matches(PLURAL, ("text",)))
    return found.select("doc_id", *(search.unit_matches(u, ("text",)).alias(f"u{i}") for i, u in enumerate(PLURAL.units)))


@q(f"WITH {idx()} SELECT count(*) FILTER ({' OR '.join(unit_sql(u) for u in FREE.units)}) AS any_unit, count(*) FILTER ({' AND '.join(unit_sql(u) for u in FREE.units)}) AS all_units FROM idx")
def any_vs_all_match(spark, sf_dir):
    found = [search.unit_matches(u, ("text",)) for u in FREE.units]
    return corpus(spark, sf_dir).agg(F.count_if(search.any_of(found)).alias("any_unit"), F.count_if(search.all_of(found)).alias("all_units"))


RARE = parse(None, [["heed"], ["zzqx"], ["with"]])


@q(
    f"WITH {idx()} "
    + " UNION ALL ".join(
        f"SELECT '{u.label}' AS unit, count(*) FILTER ({unit_sql(u)}) AS alone, count(*) FILTER ({match_sql(RARE.without(k))}) AS rest FROM idx" for k, u in enumerate(RARE.units)
    )
)
def zero_diagnosis(spark, sf_dir):
    return search.zero_diagnosis(corpus(spark, sf_dir), RARE, ("text",))


@q(f"WITH {idx()} SELECT term, count(DISTINCT doc_id) AS doc, count(*) AS cnt FROM (SELECT doc_id, unnest(string_split_regex(trim(pad_text), ' +')) AS term FROM idx) WHERE term <> '' GROUP BY term")
def vocab_df(spark, sf_dir):
    return index.vocabulary(corpus(spark, sf_dir), ("text",))


# ---- the same through postings --------------------------------------------------------------------------------------------


def indexed(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The documents' postings, in a folder named by the table's files: written by the first who asks, opened by all later."""
    named = hashlib.sha256(repr(scratch.stamp(spark, f"{sf_dir}/documents.parquet")).encode()).hexdigest()[:32]
    folder = f"{scratch.root(spark)}/florilege/postings-{named}"
    try:
        return postings.opened(spark, folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    return postings.created(table(spark, sf_dir, "documents").withColumn("issue", (F.col("doc_id") % 12).cast("int")), folder, FIELDS, "doc_id")


TEXT = search.Scoring({"text": 5.0})


@q(bm25_sql(FREE, {"text": 5.0}, FIELDS) + PICK + ORDER.format("coverage DESC,") + " LIMIT 10")
def indexed_top(spark, sf_dir):
    return rounded(postings.top(indexed(spark, sf_dir), FREE, TEXT, 10, "issue"))


INDEXED = parse('"the of" src3 heed*')


@q(bm25_sql(INDEXED, WEIGHTS.weights, FIELDS) + PICK)
def indexed_phrases(spark, sf_dir):
    return rounded(postings.scored(indexed(spark, sf_dir), INDEXED, WEIGHTS))


@q(f"WITH {idx()} SELECT doc_id, {occ(PREFIX, 'text')}::INT AS n FROM idx WHERE {has(PREFIX, 'text')}")
def indexed_prefix(spark, sf_dir):
    found = indexed(spark, sf_dir)
    counts = postings.phrase_counts(found, [PREFIX], {"text": 1.0})
    return found.docs().join(counts.drop("n_tokens"), ["segment", "doc"]).select("doc_id", F.col("f")[0].cast("int").alias("n"))


@q(
    f"WITH {idx(FIELDS)}, t AS (SELECT doc_id, 'text' AS field, unnest(string_split_regex(trim(pad_text), ' +')) AS term FROM idx UNION ALL SELECT doc_id, 'lang', unnest(string_split_regex(trim(pad_lang), ' +')) FROM idx "
    "UNION ALL SELECT doc_id, 'source', unnest(string_split_regex(trim(pad_source), ' +')) FROM idx) SELECT term, count(DISTINCT doc_id) AS doc, count(*) AS cnt FROM t WHERE term <> '' GROUP BY term"
)
def indexed_vocabulary(spark, sf_dir):
    return postings.vocabulary(indexed(spark, sf_dir))


CHANGED = "d AS (SELECT doc_id, CASE WHEN source = 'src1' THEN text || ' heed with the of' ELSE text END AS text, lang, source FROM documents WHERE source IS DISTINCT FROM 'src3')"


@q(bm25_sql(PHRASED, {"text": 5.0}, base=CHANGED + ", " + idx().replace("FROM documents", "FROM d")) + PICK)
def indexed_changes(spark, sf_dir):
    """An index built in steps: English documents, then the others and new texts of one source, less another source, then merged."""
    docs = table(spark, sf_dir, "documents").withColumn("issue", (F.col("doc_id") % 12).cast("int"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    longer = docs.filter("source = 'src1'").withColumn("text", F.concat("text", F.lit(" heed with the of")))
    made = postings.created(docs.filter(english), f"{scratch.root(spark)}/florilege/postings-{uuid.uuid4().hex}", ("text",), "doc_id")
    made = postings.added(made, docs.filter(~english & (F.coalesce("source", F.lit("")) != "src1")))
    made = postings.deleted(postings.added(made, longer), docs.filter("source = 'src3'"))
    return rounded(postings.scored(postings.merged(made, 2), PHRASED, TEXT))


def request_pads() -> str:
    pads = ", ".join(f"{PAD.format(f)} AS pad_{f}" for f in retrieval.WEIGHTS)
    return f"p AS (SELECT *, {pads} FROM w), idx AS (SELECT *, {' + '.join(COUNT.format(f'pad_{f}') for f in retrieval.WEIGHTS)} AS n_tokens FROM p)"


@q(gazette.best_sql(gazette.WIDE, request_pads(), bm25_sql) + gazette.FACETS_SQL)
def answered_panorama(spark, sf_dir):
    return gazette.answered_panorama(spark, sf_dir)


@q(gazette.best_sql(gazette.NARROW, request_pads(), bm25_sql) + gazette.hints_sql(gazette.NARROW))
def answered_hints(spark, sf_dir):
    return gazette.answered_hints(spark, sf_dir)


TERMS = ["heed", "with"]


@q(
    f"WITH {idx()}, n AS (SELECT doc_id, text, {PAD.format('text')} AS pad FROM documents), "
    "a AS (SELECT doc_id, text, nullif(strpos(pad, 'heed'), 0) AS x, nullif(strpos(pad, 'with'), 0) AS y FROM n) "
    "SELECT doc_id, md5(substring(text, greatest(coalesce(least(x, y), 1) - 20, 1)::BIGINT, 60)) AS snippet FROM a"
)
def snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("pad", index.padded(F.col("text")))
    return docs.select("doc_id", F.md5(search.snippet(F.col("text"), F.col("pad"), TERMS, 20, 60)).alias("snippet"))


# ---- filters, joins, aggregates -----------------------------------------------------------------------------------------


@q("SELECT doc_id, source FROM documents WHERE contains(translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'rc1')")
def like_ascii_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.ascii_like(F.col("source"), "RC1")).select("doc_id", "source")


@q("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'")
def date_window_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return rows.filter(search.in_dates(F.col("day"), T.given_date("01/03/1995", "first"), T.given_date("1995-06-30", "last")))


@q("SELECT o_orderkey FROM orders ORDER BY o_orderdate::DATE DESC, o_orderkey::VARCHAR DESC LIMIT 30")
def newest_first_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return search.page(rows, [F.desc("day"), F.desc(F.col("o_orderkey").cast("string"))], 30).select("o_orderkey")


FACET_QUERY = parse("heed")


@q(
    f"WITH {idx()}, m AS (SELECT doc_id, lang, source FROM idx WHERE {match_sql(FACET_QUERY)}), "
    "c AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' ELSE 'source' END AS facet, coalesce(lang, source) AS value, count(*) AS n FROM m GROUP BY GROUPING SETS ((lang), (source))) "
    "SELECT facet, value, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS k FROM c) WHERE k <= 6"
)
def panorama_facets(spark, sf_dir):
    found = corpus(spark, sf_dir).filter(search.matches(FACET_QUERY, ("text",)))
    return analytics.facets(found, ["lang", "source"])


LIFT_QUERY = parse("avec dans")


@q(
    f"WITH {idx()}, w AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(pad_text, '[a-z]{{5,}}')) AS term FROM idx)), "
    f"m AS (SELECT doc_id FROM idx WHERE {match_sql(LIFT_QUERY)}), n AS (SELECT count(*) AS n FROM m), "
    "d AS (SELECT term, count(*) AS df FROM w WHERE doc_id IN (SELECT doc_id FROM m) GROUP BY term), g AS (SELECT term, count(*) AS gdf FROM w GROUP BY term), "
    "l AS (SELECT term, df, (df / (SELECT n::DOUBLE FROM n)) / (greatest(gdf, 1) / (SELECT count(*)::DOUBLE FROM idx)) AS lift FROM d JOIN g USING (term) WHERE df >= greatest(4, floor((SELECT n FROM n) * 0.06))) "
    "SELECT term, df, round(lift, 6) AS lift FROM l WHERE lift >= 2.5 AND (SELECT n FROM n) >= 8 ORDER BY lift * sqrt(df) DESC, term DESC LIMIT 12"
)
def lift_terms(spark, sf_dir):
    words = F.regexp_extract_all("pad_text", F.lit("[a-z]{5,}"), F.lit(0))
    docs = corpus(spark, sf_dir).select("doc_id", "pad_text", words.alias("words"))
    general = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("doc"))
    found = docs.filter(search.matches(LIFT_QUERY, ("text",)))
    return analytics.lift_terms(found, F.col("words"), general, docs.count()).withColumn("lift", F.round("lift", 6))


@q("SELECT doc_id, text = '' OR text IS NULL AS empty FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_join(spark, sf_dir):
    good = table(spark, sf_dir, "labels").filter("quality = 1")
    docs = table(spark, sf_dir, "documents")
    return docs.join(good, "doc_id", "left_semi").select("doc_id", ((F.col("text") == "") | F.col("text").isNull()).alias("empty"))


@q("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@q("SELECT c_custkey, coalesce(n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def left_coalesce(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"))


@q("SELECT n_name, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total, count(*) AS orders, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def section_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("orders"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@q(
    "WITH f AS (SELECT doc_id, lang, source, n_chars FROM documents), c AS (SELECT count(*) AS total, count(*) FILTER (length(lang) < 3) AS a, count(*) FILTER (length(source) < 5) AS b FROM f) "
    "SELECT 'lang' AS field, a AS short, total FROM c UNION ALL SELECT 'source', b, total FROM c"
)
def anomaly_counts(spark, sf_dir):
    return analytics.section_anomalies(table(spark, sf_dir, "documents"), {"lang": 3, "source": 5})


@q(
    "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked_at FROM conversations"
)
def class_forward_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", parsers.forward_filled(rows, F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], ["turn", "text"]).alias("asked_at"))


@q("SELECT md5(lower(trim(text))) AS key, min(doc_id) AS doc_id, count(*) - 1 AS later FROM documents GROUP BY 1")
def dedupe_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("key"))
    first, later = store.first_wins(rows, "key", ["doc_id"])
    return first.join(later.groupBy("key").agg(F.count("*").alias("n")), "key", "left").select("key", "doc_id", F.coalesce("n", F.lit(0)).alias("later"))


@q(
    "WITH a AS (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS n FROM lineitem) "
    "SELECT l_partkey, l_orderkey, l_linenumber FROM a WHERE n > 1"
)
def republications(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate")
    return store.first_wins(rows, "l_partkey", [F.desc("l_shipdate"), "l_orderkey", "l_linenumber"])[1].drop("l_shipdate")


@q("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def upsert_replace(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return store.replaced(old, old.filter("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new")), ["c_custkey"])


@q("SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT 10000000 + n_nationkey, n_name FROM nation")
def upsert_ignore(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 10_000_000).cast("long").alias("c_custkey"), F.col("n_name").alias("c_mktsegment"))
    return store.inserted(old, new.unionByName(old.withColumn("c_mktsegment", F.lit("again"))), ["c_custkey"])


@q("SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def section_cascade_delete(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    left = store.cascade({"orders": (orders, "o_orderkey"), "lineitem": (lines, "l_orderkey")}, orders.filter("o_orderstatus = 'F'"), "o_orderkey")
    return analytics.union_all([t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in left.items()])


# ---- graph ---------------------------------------------------------------------------------------------------------------

EDGE_SQL = "WITH e AS (SELECT DISTINCT l_orderkey AS source, l_partkey::VARCHAR AS ref FROM lineitem WHERE l_quantity > 25), node AS (SELECT p_partkey::VARCHAR AS ref FROM part WHERE p_size < 40) "


@q(
    "WITH d AS (SELECT doc_id, (doc_id % 12)::INT AS issue, coalesce(lang, '') AS section, coalesce(text, '') AS t FROM documents), k AS (SELECT *, md5(t) AS old, md5(replace(t, 'the', 'THE')) AS new FROM d) "
    "SELECT doc_id, issue, section, new AS digest, CASE WHEN section <> 'en' THEN 'inserted' WHEN old = new THEN 'same' ELSE 'replaced' END AS change FROM k WHERE section <> 'fr' "
    "UNION ALL SELECT doc_id, issue + 2, section, new, 'republished' FROM k WHERE section = 'de' "
    "UNION ALL SELECT doc_id, issue, section, old, CASE WHEN issue = 5 THEN 'deleted' ELSE 'kept' END FROM k WHERE section = 'fr' "
    "UNION ALL SELECT doc_id, issue + 1, section, new, CASE WHEN issue = 5 THEN 'inserted' ELSE 'republished' END FROM k WHERE section = 'fr'"
)
def merged_changes(spark, sf_dir):
    """All documents: English and French ones are known; English come again in their issue, French in the next, German twice, others once; French ones of an issue go."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 12).cast("int").alias("issue"), F.coalesce("lang", F.lit("")).alias("section"), F.coalesce("text", F.lit("")).alias("t"))
    old = docs.filter("section IN ('en', 'fr')").select("doc_id", "issue", "section", F.md5(F.col("t").cast("binary")).alias("digest"))
    issues = F.when(F.col("section") == "fr", F.array(F.col("issue") + 1)).when(F.col("section") == "de", F.array("issue", F.col("issue") + 2)).otherwise(F.array("issue"))
    new = docs.select("doc_id", F.posexplode(issues).alias("arrival", "issue"), "section", F.md5(F.replace("t", F.lit("the"), F.lit("THE")).cast("binary")).alias("digest"))
    anew = spark.createDataFrame([(5, "fr")], "issue int, section string")
    return merge.changes(old, new, "doc_id", "issue", ["arrival"], anew)


def edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 25")
    return rows.select(F.col("l_orderkey").alias("source"), F.lit("part").alias("kind"), F.col("l_partkey").cast("string").alias("ref")).distinct()


def nodes(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size < 40").select("p_partkey")


@q(EDGE_SQL + ", t AS (SELECT ref, count(DISTINCT source) AS citing FROM e GROUP BY ref ORDER BY citing DESC, ref LIMIT 20) SELECT ref, citing, ref IN (SELECT ref FROM node) AS inside FROM t")
def indegree_top(spark, sf_dir):
    return graph.with_presence(graph.top_cited(edges(spark, sf_dir), "part", 20), nodes(spark, sf_dir), "p_partkey")


@q(EDGE_SQL + "SELECT count(DISTINCT ref) AS n FROM e WHERE ref NOT IN (SELECT ref FROM node)")
def dangling_nodes(spark, sf_dir):
    return graph.dangling(edges(spark, sf_dir), "part", nodes(spark, sf_dir), "p_partkey")


@q(EDGE_SQL + "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey IN (SELECT source FROM e WHERE ref = '7')")
def citing_docs(spark, sf_dir):
    return graph.citing(edges(spark, sf_dir), "part", "7", table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "o_orderdate")


@q(EDGE_SQL + "SELECT o_orderkey, coalesce(n, 0) AS cited FROM orders LEFT JOIN (SELECT source, count(DISTINCT ref) AS n FROM e GROUP BY source) ON source = o_orderkey")
def degree_decoration(spark, sf_dir):
    degree = edges(spark, sf_dir).groupBy(F.col("source").alias("o_orderkey")).agg(F.count_distinct("ref").alias("n"))
    return table(spark, sf_dir, "orders").join(degree, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("cited"))


@q(
    "WITH s AS (SELECT o_custkey AS g, o_orderkey AS n FROM orders), p AS (SELECT a.n, b.n AS o, row_number() OVER (PARTITION BY a.n ORDER BY b.n) AS k, count(*) OVER (PARTITION BY a.n) AS c FROM s a JOIN s b ON a.g = b.g AND a.n <> b.n) "
    "SELECT n AS o_orderkey, string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (k <= 5) AS others, max(c) > 5 AS more FROM p GROUP BY n"
)
def siblings(spark, sf_dir):
    return graph.siblings(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@q("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 AND o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)")
def other_decisions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    known = orders.filter("o_custkey = 7").agg(F.min("o_orderkey")).first()[0]
    return graph.others(orders, "o_custkey", "o_orderkey", "7", str(known)).select("o_orderkey", "o_orderstatus")


# ---- gazettes ----------------------------------------------------------------------------------------------------------------

ISSUE_SQL = "issues AS (SELECT DISTINCT o_orderkey // 10 AS issue, CASE WHEN o_orderkey // 10 % 9 <> 0 THEN DATE '2020-01-01' + (o_orderkey // 10 % 2000)::INT END AS date FROM orders), sections AS (SELECT o_orderkey // 10 AS issue, o_orderkey % 7 AS code, count(*) AS items FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) "


def gazette_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Issues of ten order numbers and their sections, by orders that are not closed."""
    orders = table(spark, sf_dir, "orders").withColumn("issue", F.floor(F.col("o_orderkey") / 10))
    dated = F.when(F.col("issue") % 9 != 0, F.date_add(F.lit("2020-01-01"), (F.col("issue") % 2000).cast("int")))
    sections = orders.filter("o_orderstatus <> 'F'").groupBy("issue", (F.col("o_orderkey") % 7).alias("code")).agg(F.count("*").alias("items"))
    return orders.select("issue").distinct().withColumn("date", dated), sections


@q("WITH " + ISSUE_SQL + "SELECT issue, (SELECT count(*) FROM sections s WHERE s.issue = i.issue) AS sections FROM issues i WHERE issue BETWEEN (SELECT min(issue) FROM sections) AND (SELECT max(issue) FROM sections) AND (SELECT count(*) FROM sections s WHERE s.issue = i.issue) < 5")
def gap_issues(spark, sf_dir):
    return analytics.gap_issues(*gazette_tables(spark, sf_dir))


@q("WITH " + ISSUE_SQL + "SELECT (SELECT count(*) FROM orders) AS decisions, count(*) AS issues, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (date IS NULL) AS undated FROM issues WHERE issue IN (SELECT issue FROM sections)")
def coverage_summary(spark, sf_dir):
    issues, sections = gazette_tables(spark, sf_dir)
    return analytics.coverage_summary(table(spark, sf_dir, "orders"), sections, issues)


for _made, _sql in (
    (gazette.outcome_labels, gazette.OUTCOME_SQL),
    (gazette.panorama_outcomes, gazette.PANORAMA_SQL),
    (gazette.anchor_edges, gazette.ANCHOR_EDGES_SQL),
    (gazette.base_ref_merge, gazette.BASE_REF_MERGE_SQL),
    (gazette.abstract_parts, gazette.ABSTRACT_PARTS_SQL),
    (gazette.section_parser, gazette.SECTION_SQL),
    (gazette.packaged_pages, gazette.PACKAGED_SQL),
    (gazette.streamed_sections, gazette.SECTION_SQL),
    (gazette.full_text_parser, gazette.FULL_TEXT_SQL),
    (gazette.quotation_labels, gazette.QUOTATION_SQL),
):
    q(_sql)(_made)


@q(
    "WITH e AS (SELECT DISTINCT l_orderkey AS o, l_partkey::VARCHAR AS ref FROM lineitem WHERE l_quantity > 25) SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT o FROM e WHERE ref = '11') AND o_orderstatus <> 'F'"
)
def cited_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    return search.citing_filter(rows, "o_orderkey", edges(spark, sf_dir), "part", "11/STJ")


@q(
    "WITH r AS (SELECT l_orderkey AS k, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS s FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey), d AS (SELECT c_custkey AS c, count(DISTINCT o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) "
    "SELECT o_orderkey, coalesce(s, '') AS republished, coalesce(n, 0) AS cited, o_orderkey % 5 = 0 AS held FROM orders LEFT JOIN r ON k = o_orderkey LEFT JOIN d ON c = o_custkey"
)
def decorated_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("case"))
    again = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("string").alias("issue"))
    degree = graph.in_degree(orders.select(F.col("o_orderkey").alias("source"), F.lit("own").alias("kind"), F.col("case").alias("ref")))
    out = analytics.decorated(orders, "o_orderkey", "case", again, degree, orders.filter("o_orderkey % 5 = 0"))
    return out.select("o_orderkey", "republished", "cited", "held")


PART_QUERY = parse("recurso desprovido")
PART_SCORING = search.field_scoring(("dispositivo", "caso"), parsers.FIELD_WEIGHTS, "cabecalho")
PART_INDEX = (
    gazette.PARTS_SQL.removeprefix("WITH ").rstrip() + ", p AS (SELECT doc_id, issue, " + ", ".join(f"{PAD.format(f)} AS pad_{f}" for f in parsers.SEARCHABLE) + " FROM parts), "
    "idx AS (SELECT *, " + " + ".join(COUNT.format(f"pad_{f}") for f in parsers.SEARCHABLE) + " AS n_tokens FROM p)"
)


@q(bm25_sql(PART_QUERY, PART_SCORING.weights, parsers.SEARCHABLE, PART_INDEX) + PICK)
def field_search(spark, sf_dir):
    return gazette.field_search(spark, sf_dir, PART_QUERY, PART_SCORING)


@q("SELECT doc_id, md5(CASE WHEN length(text) > 700 THEN substring(text, 1, 700) || '…' ELSE text END) AS digest FROM documents ORDER BY doc_id DESC LIMIT 30")
def triage_page(spark, sf_dir):
    return search.triage(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [F.desc("doc_id")]).select("doc_id", F.md5("text").alias("digest"))


# ---- text kernel -----------------------------------------------------------------------------------------------------------

T1 = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g'), '(?i)<br\\s*/?>|</p>|</div>|</tr>|</td>|</h[0-9]>', chr(10), 'g'), '<[^>]+>', '', 'g')"
)
for _n, _c in T.LOW_REFERENCES.items():
    T1 = f"replace({T1}, '&#{_n};', '{_c}')"
for _e, _c in T.ENTITIES:
    T1 = f"replace({T1}, '{_e}', '{_c.replace(chr(39), chr(39) * 2)}')"
T1 = f"regexp_replace(regexp_replace(regexp_replace(replace({T1}, chr(160), ' '), '[ \\t\\r]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@q(f"SELECT page_id, md5({T1}) AS digest, length({T1}) AS n FROM pages")
def html_to_text(spark, sf_dir):
    text = table(spark, sf_dir, "pages").select("page_id", T.html_to_text(F.col("html")).alias("t"))
    return text.select("page_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@q("SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents")
def fold_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_accents(F.col("text"))).alias("digest"))


SQL_FULL_NORM = "lower(strip_accents(translate(text, 'ºª', 'oa')))"
for _p, _t in T.NORM_RULES:
    SQL_FULL_NORM = f"regexp_replace({SQL_FULL_NORM}, '{_p.replace(chr(39), chr(39) * 2)}', '{_t.replace('$1', chr(92) + '1').replace(chr(39), chr(39) * 2)}', 'g')"


@q(f"SELECT doc_id, md5(trim({SQL_FULL_NORM})) AS digest FROM documents")
def norm_form(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.norm(F.col("text"))).alias("digest"))


@q("SELECT o_orderkey, o_orderdate::DATE AS day, strftime(o_orderdate, '%d/%m/%Y') AS short FROM orders")
def long_dates(spark, sf_dir):
    names = F.array(*(F.lit(m.title().replace("Marco", "Março")) for m in T.MONTHS))
    rows = table(spark, sf_dir, "orders")
    written = F.concat(F.lit("Aracaju, "), F.dayofmonth("o_orderdate"), F.lit(" de "), F.element_at(names, F.month("o_orderdate")), F.lit(" de "), F.year("o_orderdate"), F.lit("."))
    return rows.select("o_orderkey", T.long_date(written).alias("day")).withColumn("short", T.short_date(F.col("day")))


@q("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def receipt_hash(spark, sf_dir):
    return store.receipts(table(spark, sf_dir, "documents"), "doc_id", "text")


@q("SELECT p_partkey, regexp_replace(p_brand, '[^0-9]', '', 'g') AS digits, trim(split_part(p_name, ' ', 1)) AS head FROM part")
def small_scalars(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.digits(F.col("p_brand")).alias("digits"), T.base_ref(F.replace("p_name", F.lit(" "), F.lit("/"))).alias("head"))


# ---- verification ------------------------------------------------------------------------------------------------------------


@q(
    "WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM documents), b AS (SELECT item_id, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS u FROM benchmark) "
    "SELECT doc_id, item_id, strpos(t, u) AS at FROM d JOIN b ON contains(t, u)"
)
def quote_verify(spark, sf_dir):
    return verify.containments(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


# ---- requests over time --------------------------------------------------------------------------------------------------------


@q("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def sliding_rate(spark, sf_dir):
    return admission.sliding_counts(table(spark, sf_dir, "events"), "user_id", "ts", 600).select("event_id", "recent")


def by_level(k: int) -> str:
    return "(CASE level " + " ".join(f"WHEN {n} THEN {step[k]}" for n, step in enumerate(admission.LADDER)) + " END)"


#: A row an event, each from the state after the one before of its key.
LEVELS_SQL = (
    "WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts::TIMESTAMP) / 1e6 AS tick, event_type = 'error' AS refused, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts::TIMESTAMP, event_id) AS n FROM events), "
    "s AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, '' AS decision, 0 AS level, []::DOUBLE[] AS reqs, 0.0::DOUBLE AS paused, 0 AS clean, NULL::DOUBLE AS last FROM (SELECT DISTINCT key FROM e) UNION ALL "
    "SELECT key, n, id, decision, CASE WHEN decision <> 'admitted' THEN level WHEN refused THEN least(level + 1, " + str(len(admission.LADDER) - 1) + f") WHEN level > 0 AND clean + 1 >= {admission.CLEAN_TO_DESCEND} THEN level - 1 ELSE level END, "
    "CASE WHEN decision = 'admitted' THEN list_append(reqs, tick) ELSE reqs END, "
    f"CASE WHEN decision = 'admitted' AND refused THEN greatest(paused, tick + {admission.PAUSES['blocked']}) ELSE paused END, "
    f"CASE WHEN decision <> 'admitted' THEN clean WHEN refused THEN 0 WHEN level > 0 THEN (CASE WHEN clean + 1 >= {admission.CLEAN_TO_DESCEND} THEN 0 ELSE clean + 1 END) ELSE clean END, tick "
    f"FROM (SELECT *, CASE WHEN paused > tick THEN 'paused' WHEN len(reqs) >= {admission.DAY_MOST} THEN 'day' WHEN len(list_filter(reqs, lambda t: tick - t < {admission.WINDOW_S})) >= {by_level(1)} THEN 'window' "
    f"WHEN len(reqs) > 0 AND list_max(reqs) + {by_level(0)} > tick THEN 'spacing' ELSE 'admitted' END AS decision FROM ("
    f"SELECT e.key, e.n, e.id, e.tick, e.refused, CASE WHEN gone THEN 0 ELSE level END AS level, CASE WHEN gone THEN [] ELSE list_filter(reqs, lambda t: tick - t >= 0 AND tick - t < {admission.DAY_S}) END AS reqs, "
    "CASE WHEN gone THEN 0 ELSE paused END AS paused, CASE WHEN gone THEN 0 ELSE clean END AS clean "
    f"FROM (SELECT s.*, e AS e, coalesce(e.tick - last >= {admission.FORGET_S}, false) AS gone, e.tick AS tick FROM s JOIN e ON e.key IS NOT DISTINCT FROM s.key AND e.n = s.n + 1)))) "
    "SELECT key, id, decision, level FROM s WHERE n > 0"
)


@q(LEVELS_SQL)
def admission_levels(spark, sf_dir):
    return admission.replay(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", "event_id")


# ---- evaluation -----------------------------------------------------------------------------------------------------------------

RANK_SQL = "r AS (SELECT o_custkey AS query, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), g AS (SELECT o_custkey AS query, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F') "


def ranking(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("o_totalprice"), "id")))


@q("WITH " + RANK_SQL + "SELECT g.query, count(*) AS essentials, round((count(*) FILTER (rank <= 3))::DOUBLE / count(*), 6) AS recall_at_3, round((count(*) FILTER (rank <= 10))::DOUBLE / count(*), 6) AS recall_at_10 FROM g LEFT JOIN r ON r.query = g.query AND r.id = g.id GROUP BY g.query")
def recall_at_k(spark, sf_dir):
    r = ranking(spark, sf_dir)
    out = evaluate.recall_at(r, r.filter("o_orderstatus = 'F'"), (3, 10))
    return out.select("query", "essentials", *(F.round(c, 6).alias(c) for c in ("recall_at_3", "recall_at_10")))


@q("WITH m AS (SELECT lang AS method, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT method, round((count(*) FILTER (quality + toxic >= 1))::DOUBLE / count(*), 6) AS precision FROM m LEFT JOIN labels USING (doc_id) WHERE rank <= 50 GROUP BY method")
def precision_at_k(spark, sf_dir):
    nth = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = table(spark, sf_dir, "documents").select(F.col("lang").alias("method"), F.lit(0).alias("query"), F.col("doc_id").alias("id"), nth.alias("rank"))
    judged = table(spark, sf_dir, "labels").select(F.lit(0).alias("query"), F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("grade"))
    return evaluate.precision_at(ranked, judged, 50, 1).select("method", F.round("precision", 6).alias("precision"))


COSINE = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


@q(f"SELECT query_id, id, rank::INT AS rank, round(c, 6) AS cosine FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {COSINE} AS c, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, v.vec_id) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 10")
def cosine_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return evaluate.dense_top(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("cosine", F.round("cosine", 6))


@q(
    "WITH a AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM documents), b AS (SELECT lang AS query, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS rank FROM documents), "
    "u AS (SELECT * FROM a WHERE rank < 50 UNION ALL SELECT * FROM b WHERE rank < 50), s AS (SELECT query, id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM u GROUP BY query, id) "
    "SELECT query, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM s) WHERE k <= 10"
)
def rrf_fusion(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("id"), "n_chars")
    rank = lambda *by: rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*by)) - 1).filter("rank < 50")
    return evaluate.fused([rank(F.desc("n_chars"), "id"), rank("id")], 60, 10).withColumn("score", F.round("score", 9))


@q(
    "WITH n AS (SELECT count(*)::DOUBLE AS a, (count(*) FILTER (lang = 'fr'))::DOUBLE AS t FROM documents), w AS (SELECT DISTINCT doc_id, lang, term FROM (SELECT doc_id, lang, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents)), "
    "c AS (SELECT term, count(*) FILTER (lang = 'fr') AS in_target, count(*) AS in_all FROM w GROUP BY term) SELECT term, in_target, in_all, round((in_target / t) / (in_all / a), 6) AS ratio FROM c, n WHERE in_target >= 40"
)
def cooccurrence_ratio(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = evaluate.cooccurrence(docs, F.split(F.lower("text"), "[^a-z]+"), F.col("lang") == "fr", 40)
    return out.withColumn("ratio", F.round("ratio", 6))


@q(
    "WITH b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_mktsegment END AS seg, c_nationkey AS nat FROM customer WHERE c_custkey % 11 <> 0), a AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS nat FROM customer), "
    "j AS (SELECT a.k AS ak, b.k AS bk, a.seg IS DISTINCT FROM b.seg AS s, a.nat IS DISTINCT FROM b.nat AS n FROM a FULL JOIN b ON a.k = b.k) "
    "SELECT '__missing__' AS field, count(*) FILTER (ak IS NULL OR bk IS NULL) AS differing FROM j UNION ALL SELECT 'seg', count(*) FILTER (s AND ak IS NOT NULL AND bk IS NOT NULL) FROM j UNION ALL SELECT 'nat', count(*) FILTER (n AND ak IS NOT NULL AND bk IS NOT NULL) FROM j"
)
def parity_diff(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    b = a.filter("k % 11 <> 0").withColumn("seg", F.when(F.col("k") % 7 == 0, "x").otherwise(F.col("seg")))
    return evaluate.parity(a, b, "k")


@q(
    "WITH l AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) SELECT doc_id, lang FROM l WHERE k <= CASE lang WHEN 'en' THEN 14 WHEN 'fr' THEN 6 WHEN 'de' THEN 3 ELSE 0 END"
)
def stratified_sample(spark, sf_dir):
    quotas = spark.createDataFrame([("en", 14), ("fr", 6), ("de", 3)], "lang string, quota int")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return evaluate.stratified(docs, table(spark, sf_dir, "labels"), quotas, "lang", "doc_id", "doc_id")


@q("SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '[0-9]{3}[.-][0-9]{2,}')")
def blind_scan(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_if(F.col("text").rlike("[0-9]{3}[.-][0-9]{2,}")).alias("n"))


@q("SELECT round((count(*) FILTER (quality = 1 AND n_chars > 1500))::DOUBLE / count(*) FILTER (quality = 1), 6) AS detected, round((count(*) FILTER (quality <> 1 AND n_chars > 1500))::DOUBLE / count(*) FILTER (quality <> 1), 6) AS false_alarm FROM documents JOIN labels USING (doc_id)")
def detection_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    out = evaluate.detection(rows.select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 1500).alias("fired")))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@q("SELECT count(*) FILTER (CAST(c_acctbal AS DOUBLE) > 1000) AS n FROM customer WHERE 'empty:' || c_nationkey || ':' || c_custkey LIKE 'empty:7:%'")
def prefix_marks(spark, sf_dir):
    marks = table(spark, sf_dir, "customer").select(F.concat_ws(":", F.lit("empty"), "c_nationkey", "c_custkey").alias("key"), F.col("c_acctbal").cast("string").alias("value"))
    return store.recent_marks(marks, "empty:7:", 1000.0).agg(F.count("*").alias("n"))


@q("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS p FROM orders), l AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name) - 1 AS p FROM customer) SELECT o_orderkey, c_custkey, p AS position FROM o JOIN l USING (p)")
def positional_join(spark, sf_dir):
    orders = evaluate.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    customers = evaluate.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), ["c_name"])
    return orders.join(customers, "position").select("o_orderkey", "c_custkey", "position")


@q("SELECT o_orderkey, '([TJSE, Apelação ' || o_orderkey || ', processo nº ' || o_custkey || ', acórdão nº ' || o_orderkey || ', Rel. Fulano de Tal, 1ª Câmara Cível' || CASE WHEN o_orderkey % 2 = 0 THEN ', julgado em ' || strftime(o_orderdate, '%d/%m/%Y') ELSE '' END || '](x)) — verificação: lido' AS citation FROM orders")
def citations(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    judged = F.when(F.col("o_orderkey") % 2 == 0, F.to_date("o_orderdate"))
    made = T.citation(F.concat(F.lit("Apelação "), "o_orderkey"), F.col("o_custkey"), F.col("o_orderkey"), F.lit("FULANO DE TAL"), F.lit("1ª Câmara Cível"), judged, F.lit("x"), "lido")
    return rows.select("o_orderkey", made.alias("citation"))


def month_start(today: dt.date, months: int) -> dt.date:
    """The first day of the month `months` before."""
    n = today.year * 12 + today.month - 1 - months
    return dt.date(n // 12, n % 12 + 1, 1)
