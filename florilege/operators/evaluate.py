"""Evaluation: recall and precision at k, dense nearest rows, rank fusion, co-occurrence, parity of two outputs, sampling by quota."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from florilege.operators import scratch


def recall_at(ranking: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = (10, 50, 200)) -> DataFrame:
    """query, essentials, recall_at_<k>: `ranking` (query, id, rank from 1), `gold` (query, id)."""
    hits = gold.select("query", "id").distinct().join(ranking.select("query", "id", "rank"), ["query", "id"], "left")
    shares = [(F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_at_{k}") for k in cutoffs]
    return hits.groupBy("query").agg(F.count("*").alias("essentials"), *shares)


def precision_at(ranking: DataFrame, judged: DataFrame, k: int = 10, relevant: int = 2) -> DataFrame:
    """method, precision: the share of the first k whose grade reaches `relevant`; `ranking` (method, query, id, rank)."""
    top = ranking.filter(F.col("rank") <= k).join(judged, ["query", "id"], "left")
    return top.groupBy("method").agg((F.count_if(F.col("grade") >= relevant) / F.count("*")).alias("precision"))


def deltas(before: DataFrame, after: DataFrame, key: str, measures: list[str]) -> DataFrame:
    pairs = before.alias("a").join(after.alias("b"), key, "full")
    return pairs.select(key, *((F.coalesce(F.col(f"b.{m}"), F.lit(0.0)) - F.coalesce(F.col(f"a.{m}"), F.lit(0.0))).alias(m) for m in measures))


#: Queries sent to all rows at a time, and rows scored against them side by side.
QUERY_BLOCK, ROW_BLOCK = 10_000, 512


def dense_top(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """query_id, id, rank, cosine: exact, for a stated set of queries that is sent to all rows, as products of blocks.

    A task passes on the k best rows of each query. Null and zero vectors, and those of another length, take no part."""
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)[id_col]
    blocks = -(-queries.count() // QUERY_BLOCK)
    if blocks > 1:
        part = F.pmod(F.xxhash64(id_col), F.lit(2 * blocks))
        return reduce(DataFrame.unionByName, [dense_top(vectors, queries.filter(part == b), id_col, vector_col, k) for b in range(2 * blocks)])
    rows = [(r[0], r[1]) for r in queries.select(id_col, F.col(vector_col).cast("array<double>")).collect()]  # QUERY_BLOCK rows at most
    shared = spark.sparkContext.broadcast([(i, v) for i, v in rows if v and None not in v and any(v)])
    schema = f"query_id {kind}, id {kind}, cosine double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best: list[list[tuple[float, object]]] = [[] for _ in asked]
        sides = {n: (np.array([j for j, (_, v) in enumerate(asked) if len(v) == n]), np.array([v for _, v in asked if len(v) == n])) for n in {len(v) for _, v in asked}}
        sides = {n: (at, m / np.sqrt((m * m).sum(1))[:, None]) for n, (at, m) in sides.items()}
        for b in batches:
            ids, found = b.column(0).to_pylist(), b.column(1).to_pylist()
            for n, (at, m) in sides.items():
                good = [i for i, v in enumerate(found) if v and len(v) == n and None not in v and any(v)]
                for lo in range(0, len(good), ROW_BLOCK):
                    some = good[lo : lo + ROW_BLOCK]
                    x = np.array([found[i] for i in some])
                    products = m @ (x / np.sqrt((x * x).sum(1))[:, None]).T
                    for row, j in enumerate(at.tolist()):
                        held = best[j]
                        least = held[-1][0] - 1e-12 if len(held) > k else -np.inf
                        near = np.flatnonzero(-products[row] <= -least) if len(held) > k else np.arange(len(some))
                        if len(near) > k + 1:
                            near = near[products[row][near] >= np.partition(products[row][near], -k - 1)[-k - 1] - 1e-12]
                        new = [(exact(asked[j][1], found[some[i]]), ids[some[i]]) for i in near.tolist() if ids[some[i]] != asked[j][0]]
                        best[j] = sorted([*held, *new], key=lambda c: (-c[0], c[1]))[: k + 1] if new else held
        rows = [(asked[j][0], i, c) for j, held in enumerate(best) for c, i in held[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((to_arrow_type(id_type), to_arrow_type(id_type), pa.float64()))], ["query_id", "id", "cosine"])

    id_type = vectors.schema[id_col].dataType
    pairs = vectors.select(id_col, F.col(vector_col).cast("array<double>")).filter(F.col(id_col).isNotNull()).mapInArrow(run, schema)
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
    return pairs.withColumn("rank", nth).filter(F.col("rank") <= k)


def exact(a: list[float], b: list[float]) -> float:
    """The cosine of a pair by sums in the order of the components, whatever block it came in."""
    dot = lambda x, y: sum(map(mul, x, y))
    return dot(a, b) / math.sqrt(dot(a, a) * dot(b, b))


def fused(rankings: list[DataFrame], k: int = 60, top: int | None = None) -> DataFrame:
    """query, id, score: reciprocal ranks, ranks from 0, over rankings (query, id, rank from 0)."""
    rows = reduce(DataFrame.unionByName, [r.select("query", "id", "rank") for r in rankings])
    out = rows.groupBy("query", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    if top is None:
        return out
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return out.withColumn("_n", nth).filter(F.col("_n") <= top).drop("_n")


def candidates(first: Column, second: Column) -> Column:
    """Two candidate lists as one, in order, each id once."""
    return F.array_distinct(F.concat(first, second))


def reranked(rows: DataFrame, scorer, k: int) -> DataFrame:
    """The k best of each query by `scorer`, a function of the rows' columns to a Column (a UDF around a model, say)."""
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return rows.withColumn("score", scorer(rows)).withColumn("rank", nth).filter(F.col("rank") <= k)


def cooccurrence(rows: DataFrame, terms: Column, target: Column, least: int = 5) -> DataFrame:
    """term, in_target, in_all, ratio: a term's share of the target rows over its share of all rows."""
    n = rows.agg(F.count("*").alias("n_all"), F.count_if(target).alias("n_target"))
    counts = rows.select(target.alias("_t"), F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count_if("_t").alias("in_target"), F.count("*").alias("in_all"))
    ratio = (F.col("in_target") / F.col("n_target")) / (F.col("in_all") / F.col("n_all"))
    return counts.filter(F.col("in_target") >= least).join(F.broadcast(n)).select("term", "in_target", "in_all", ratio.alias("ratio"))  # one row


def parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """field, differing: rows on either side whose field is not the same on the other; `__missing__` for keys of one side."""
    fields = [c for c in left.columns if c != key]
    both = left.withColumn("_l", F.lit(1)).alias("a").join(right.withColumn("_r", F.lit(1)).alias("b"), key, "full")
    present = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    one = [F.count_if(present & ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f) for f in fields]
    counted = both.agg(F.count_if(~present).alias("__missing__"), *one)
    return counted.select(F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("differing")) for f in ["__missing__", *fields]))))


def table_hash(rows: DataFrame) -> DataFrame:
    """rows, hash: a figure of a table's rows, whatever their order."""
    line = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns))), 256)
    return rows.select(F.conv(F.substring(line, 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("rows"), F.sum("h").cast("string").alias("hash"))


def stratified(rows: DataFrame, held: DataFrame, quotas: DataFrame, stratum: str, key: str, newest: str) -> DataFrame:
    """The newest rows of each stratum up to its quota, those already held left out. `quotas` (stratum, quota)."""
    left = rows.join(held.select(key), key, "left_anti").join(quotas, stratum)
    nth = F.row_number().over(W.partitionBy(stratum).orderBy(F.desc(newest), F.desc(key)))
    return left.withColumn("_n", nth).filter(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def detection(rows: DataFrame) -> DataFrame:
    """detected, false_alarm: of labelled windows (truth, fired), both boolean."""
    return rows.agg(
        (F.count_if(F.col("truth") & F.col("fired")) / F.count_if("truth")).alias("detected"),
        (F.count_if(~F.col("truth") & F.col("fired")) / F.count_if(~F.col("truth"))).alias("false_alarm"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `position`, from 0 in `order`, by which tables that belong together line by line are joined.

    The rows are sorted and written; a row's place in its file and the files' sizes give its position, so no task holds all."""
    spark = rows.sparkSession
    stored = spark.read.parquet(scratch.written(rows.orderBy(*order), "sorted"))
    placed = stored.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = placed.groupBy("_file").agg(F.count("*").alias("_n"))  # a row a file
    ahead = files.select("_file", F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    return placed.join(ahead, "_file").withColumn("position", F.col("_ahead") + F.col("_at")).drop("_file", "_at", "_ahead")
