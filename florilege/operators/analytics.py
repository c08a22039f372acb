"""What a set of results says: outcomes, facets, vocabulary that sets it apart, coverage and gaps of the collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.functions.text import given

TOP_ROWS, LEAST_LIFT, LEAST_ROWS, MOST_HINTS = 800, 2.5, 8, 12
#: How a judgment's outcome is worded in the comparison form.
APPEALS = "recurso|apelacao|agravo|embargos|acao|revisao criminal|mandado de seguranca|incidente|reclamacao|conflito|apelo"
NOT_HEARD = rf"\b(?:{APPEALS})s?(?: \w+){{0,4}}? (?:nao (?:se )?conhecid\w+|nao conhecimento)|\bnao conhec(?:o|eram|eu|er|imento) d[oa]s? (?:recurso|apelacao|agravo|embargos|apelo)"
PARTLY = r"\bparcialmente provid\w+|\bprovid\w+ em parte|\bparcial provimento|\bdeu-se parcial provimento|\bdera(?:m)? parcial provimento"
DENIED = r"\bdesprovi\w+|\bimprovi\w+|\bnao provid\w+|\bnegar? (?:-se )?provimento|\bnega-se provimento|\bnegou provimento|\bnegado provimento|\bprovimento negado"
GRANTED = r"\bprovid[oa]s?\b|\bdar? (?:-se )?provimento|\bdeu-se provimento|\bderam provimento|\bdou provimento"
OUTCOMES = ("desprovido", "provido", "parcialmente provido", "não conhecido", "sem resultado identificável")


def outcome(norm: Column) -> Column:
    """The outcome that a text in comparison form declares, null unless it declares exactly one.

    The form is made once a row; a wording was there if taking it out changed the text."""

    def said(t: Column, no_part: Column, no_denial: Column) -> Column:
        return F.array_compact(
            F.array(
                F.when(t.rlike(NOT_HEARD), "não conhecido"),
                F.when(no_part != t, "parcialmente provido"),
                F.when(no_denial != no_part, "desprovido"),
                F.when(no_denial.rlike(GRANTED), "provido"),
            )
        )

    without = lambda t, wording: F.regexp_replace(t, wording, " ")
    found = given(norm, lambda t: given(without(t, PARTLY), lambda u: given(without(u, DENIED), lambda v: said(t, u, v))))
    return given(found, lambda f: F.when(F.size(f) == 1, F.get(f, 0)))


def facets(rows: DataFrame, columns: list[str], top: int = 6) -> DataFrame:
    """facet, value, n: the `top` values of each column, all from one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    counts = rows.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("nth", nth).filter(F.col("nth") <= top).drop("nth")


def panorama(rows: DataFrame, order: list[Column], norm: Column, anchors: Column, columns: list[str], most: int = TOP_ROWS, least: int = 5) -> DataFrame:
    """facet, value, n over the `most` best rows by score alone: declared outcome, the given columns, precedents cited twice or more.

    `norm` is the comparison form of a row's text, `anchors` the array of precedents in the raw text."""
    best = rows.orderBy(*order).limit(most)
    best = best.select(*columns, F.coalesce(outcome(norm), F.lit(OUTCOMES[-1])).alias("outcome"), F.array_distinct(anchors).alias("_anchors"))
    pairs = F.concat(
        F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ["outcome", *columns])),
        F.transform("_anchors", lambda a: F.struct(F.lit("anchor").alias("facet"), a.alias("value"))),
    )
    counts = best.select(F.inline(pairs)).groupBy("facet", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "value"))
    top = F.when(F.col("facet") == "anchor", 8).otherwise(6)
    found = counts.filter((F.col("facet") != "anchor") | (F.col("n") >= 2)).withColumn("nth", nth).filter(F.col("nth") <= top).drop("nth")
    enough = counts.filter("facet = 'outcome'").agg((F.sum("n") >= least).alias("enough"))
    return found.join(F.broadcast(enough), F.col("enough")).drop("enough")  # one row


def decorated(rows: DataFrame, key: str, process: str, republications: DataFrame, in_degree: DataFrame, receipts: DataFrame) -> DataFrame:
    """`rows` with the issues that print a decision again, how often its case is cited, and whether its receipt is held."""
    again = republications.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set("issue")), ",").alias("republished"))
    cited = in_degree.select(F.col("ref").alias(process), F.col("in_degree").alias("cited"))
    held = receipts.select(key, F.lit(True).alias("_held")).distinct()
    out = rows.join(again, key, "left").join(cited, process, "left").join(held, key, "left")
    return out.withColumns({"republished": F.coalesce("republished", F.lit("")), "cited": F.coalesce("cited", F.lit(0)), "held": F.col("_held").isNotNull()}).drop("_held")


def lift_terms(rows: DataFrame, words: Column, vocabulary: DataFrame, n_all: int, excluded: list[str] = (), most: int = MOST_HINTS) -> DataFrame:
    """term, df, lift: words much commoner in `rows` than in the collection. `words` is the array of a row's words."""
    # a term of null stands for the row itself: its count is the number of rows, from the same pass
    marked = F.concat(F.array_distinct(words), F.array(F.lit(None).cast("string")))
    counts = rows.select(F.explode(marked).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = counts.agg(F.coalesce(F.max(F.when(F.col("term").isNull(), F.col("df"))), F.lit(0)).alias("_n"))
    df = counts.filter(F.col("term").isNotNull() & ~F.col("term").isin(list(excluded))).join(F.broadcast(total))  # one row
    df = df.filter((F.col("_n") >= LEAST_ROWS) & (F.col("df") >= F.greatest(F.lit(4), F.floor(F.col("_n") * 0.06))))
    both = df.join(vocabulary.select("term", F.col("doc").alias("_all")), "term", "left")
    lift = (F.col("df") / F.col("_n").cast("double")) / (F.greatest(F.coalesce("_all", F.lit(1)), F.lit(1)) / F.lit(float(max(n_all, 1))))
    both = both.withColumn("lift", lift).filter(F.col("lift") >= LEAST_LIFT)
    return both.orderBy(F.desc(F.col("lift") * F.sqrt("df")), F.desc("term")).limit(most).select("term", "df", "lift")


def coverage_summary(decisions: DataFrame, sections: DataFrame, issues: DataFrame) -> DataFrame:
    """decisions, issues, first and last date, and issues without a date; one row."""
    held = issues.join(sections.select("issue").distinct(), "issue", "left_semi")
    totals = decisions.agg(F.count("*").alias("decisions"))
    return totals.join(held.agg(F.count("*").alias("issues"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("date").isNull()).alias("undated")))


def gap_issues(issues: DataFrame, sections: DataFrame, least: int = 5) -> DataFrame:
    """Issues between the first and last that have sections, with fewer than `least` of them, none included."""
    span = sections.agg(F.min("issue").alias("lo"), F.max("issue").alias("hi"))
    counts = sections.groupBy("issue").agg(F.count("*").alias("n"))
    within = issues.join(F.broadcast(span), F.col("issue").between(F.col("lo"), F.col("hi")))  # one row
    return within.join(counts, "issue", "left").select("issue", F.coalesce("n", F.lit(0)).cast("long").alias("sections")).filter(F.col("sections") < least)


def section_anomalies(items: DataFrame, least: dict[str, int]) -> DataFrame:
    """field, short, total: values shorter than their least length."""
    counted = items.agg(F.count("*").alias("total"), *(F.count_if(F.length(F.coalesce(c, F.lit(""))) < k).alias(c) for c, k in least.items()))
    return counted.select("total", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("short")) for c in least)))).select("field", "short", "total")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)
