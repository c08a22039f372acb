"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only.

Sources are ranked by code point, null last, and weigh `weights[rank % len(weights)]`. They share all words by weight;
a target stops at `max_epochs` times its source's size and the excess is shared anew (water filling, in closed form
over the sources ranked by cap / weight). Each source's demand over training time t in [0, 1] has the density
target * (1 + tilt * (2t - 1)); its integral is inverted at a document's place in its source's word stream, which
gives the training position. The stream of a source is its documents by MD5 of seed and doc_id, pass after pass.

Prefix sums are made in two levels, by MD5 bucket and within a bucket, so a source with any share of the rows is dealt
over `2 ** 12` groups. The table of sources is the only one ranked in one task: it has a row per distinct source.

Defined results: a null or empty text has size 0 and nothing is taken of it; a null source is a source of its own,
told apart from the empty string; repeated doc_ids are separate rows of the stream, ordered by size; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, "mix"
#: By weight class: early, even and late sources.
TILTS = (-0.5, 0.0, 0.5)
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: str = SEED, row: str | None = None) -> DataFrame:
    source = F.col("source").cast("string")
    return docs.select(
        "doc_id",
        F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source, F.lit(""))).alias("src"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("ord"),
        *([row] if row else []),
    ).withColumn("bucket", F.substring("ord", 1, 3))


def targets(by_source: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """`by_source` (src, source_size) with weight and target."""
    nth = F.row_number().over(W.orderBy("src")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    big = "decimal(38,0)"
    s = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    # caps and sums stay exact as decimals
    s = s.withColumn("ratio", F.col("cap").cast("decimal(30,6)") / F.col("weight").cast("decimal(7,0)"))
    by_ratio = W.orderBy("ratio", "src")
    everything = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("capped", F.col("cap").cast(big) * F.col("weight_from") <= F.col("weight") * (F.col("total") - F.col("capped_before")).cast(big))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("rest_weight", F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything))
    )
    share = F.col("weight") * F.col("rest").cast("double") / F.col("rest_weight").cast("double")
    return s.select("src", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def invert(y: Column, tilt: Column) -> Column:
    """The t at which t + tilt * (t * t - t) reaches y."""
    b = 1.0 - tilt
    return 2.0 * y / (b + F.sqrt(b * b + 4.0 * tilt * y))


def placed(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, tilts=TILTS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target, quota (its source's words taken), at (words of its source before it), tilt; `row`, a
    column that numbers the rows, if named."""
    rows = materialize(sized(docs, seed, row), "sizes", narrow=True)
    numbers = [row] if row else []
    buckets = rows.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
    totals = targets(buckets.groupBy("src").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ahead = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").join(totals, "src")
    within = W.partitionBy("src", "bucket").orderBy("ord", "size", *numbers).rowsBetween(W.unboundedPreceding, -1)
    tilt = F.element_at(F.array(*map(F.lit, tilts)), F.col("weight"))
    return (
        rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(buckets, ["src", "bucket"])
        .select("doc_id", "size", "source_size", "target", F.floor(F.col("target") + 0.5).alias("quota"), (F.col("ahead") + F.col("inside")).alias("at"), tilt.alias("tilt"), *numbers)
    )


def words_of_pass(p: int) -> Column:
    left = F.col("quota") - p * F.col("source_size") - F.col("at")
    return F.least(F.greatest(left, F.lit(0)), F.col("size"))


def position_of_pass(p: int) -> Column:
    y = (p * F.col("source_size") + F.col("at") + words_of_pass(p) / 2.0) / F.greatest(F.col("target"), F.lit(1.0))
    return F.when(words_of_pass(p) > 0, invert(F.least(y, F.lit(1.0)), F.col("tilt")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, position (of the first pass, null if none), range-sorted by position."""
    passes = range(options.get("max_epochs", MAX_EPOCHS))
    taken = sum((words_of_pass(p) for p in passes), F.lit(0)).cast("long")
    out = placed(docs, **options).select("doc_id", "size", "source_size", "target", taken.alias("taken"), position_of_pass(0).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def passes(docs: DataFrame, **options) -> DataFrame:
    """One row per pass that takes words of a document: doc_id, pass, words, position; range-sorted by position."""
    each = [F.struct(F.lit(p).alias("pass"), words_of_pass(p).alias("words"), position_of_pass(p).alias("position")) for p in range(options.get("max_epochs", MAX_EPOCHS))]
    rows = placed(docs, **options).select("doc_id", F.inline(F.array(*each)))
    return rows.filter("words > 0").orderBy("position", "doc_id", "pass")


ORACLE = """
WITH d AS (SELECT doc_id, (source IS NULL)::INT::VARCHAR || coalesce(source, '') AS src,
  coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, '')) AS ord FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY src) - 1) % 3 + 1 AS w FROM d GROUP BY src),
c AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
  coalesce(sum(3 * source_size) OVER (ORDER BY 18 * source_size // w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  sum(w) OVER (ORDER BY 18 * source_size // w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS wfrom FROM s),
k AS (SELECT *, cap::HUGEINT * wfrom <= w::HUGEINT * (total - before) AS capped FROM c),
t AS (SELECT src, source_size, w, CASE WHEN capped THEN cap::DOUBLE ELSE w * (total - coalesce(sum(cap) FILTER (capped) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM k),
p AS (SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS quota, (w - 2) / 2.0::DOUBLE AS tilt,
  coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY ord, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead FROM d JOIN t USING (src)),
f AS (SELECT *, least(greatest(quota - ahead, 0), size) AS w0 FROM p),
y AS (SELECT *, least((ahead + w0 / 2.0::DOUBLE) / greatest(target, 1.0), 1.0::DOUBLE) AS y FROM f)
SELECT doc_id, size, source_size, target,
  (w0 + least(greatest(quota - source_size - ahead, 0), size) + least(greatest(quota - 2 * source_size - ahead, 0), size))::BIGINT AS taken,
  CASE WHEN w0 > 0 THEN round(2 * y / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y)), 9) END AS position FROM y
"""
