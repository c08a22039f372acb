"""The text index: per field a padded token string, and the number of tokens of the row.

` w1  w2  w3 ` (tokens between two blanks) lets a phrase be found and counted by plain string search in the JVM, without
arrays: neighbours never share a separator. A row's size counts all indexed fields, whatever is searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import TOKEN, fold_accents


def padded(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(fold_accents(F.coalesce(text, F.lit("")))), TOKEN, "  "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def token_count(pad: Column) -> Column:
    gaps = (F.length(pad) - F.length(F.replace(pad, F.lit("  "), F.lit("")))) / 2
    return F.when(F.length(pad) > 2, gaps.cast("long") + 1).otherwise(F.lit(0).cast("long"))


def build_index(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """`docs` with `pad_<field>` for each field and `n_tokens`."""
    out = docs.select("*", *(padded(F.col(f)).alias(f"pad_{f}") for f in fields))
    return out.withColumn("n_tokens", sum((token_count(F.col(f"pad_{f}")) for f in fields), F.lit(0)).cast("long"))


def tokens(pad: Column) -> Column:
    """The tokens as an array."""
    return F.filter(F.split(pad, " "), lambda t: t != "")


def vocabulary(index: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """term, doc (rows that have it), cnt (occurrences), over all fields."""
    rows = index.select(F.sort_array(tokens(F.concat(*(F.col(f"pad_{f}") for f in fields)))).alias("t"))
    # a row's tokens in order tell its first of each term, so one aggregate by term, combined before its shuffle, has both figures
    marked = F.transform("t", lambda x, i: F.struct(x.alias("term"), F.when(F.get(F.col("t"), i - 1) == x, 0).otherwise(1).alias("first")))
    return rows.select(F.inline(marked)).groupBy("term").agg(F.sum("first").alias("doc"), F.count("*").alias("cnt"))
