"""The citation graph: edges (source, kind, ref), in-degree, who cites a reference, and what is cited but absent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.functions.text import base_ref


def top_cited(edges: DataFrame, kind: str, k: int, merge: bool = False) -> DataFrame:
    """ref, citing: the `k` most cited. Merged, a reference with its court (`Tema 7/STJ`) and without are one."""
    rows = edges.filter(F.col("kind") == kind)
    by = base_ref(F.col("ref")) if merge else F.col("ref")
    counted = rows.groupBy(by.alias("_key")).agg(F.max("ref").alias("ref"), F.count_distinct("source").alias("citing"))
    return counted.select("ref", "citing").orderBy(F.desc("citing"), "ref").limit(max(3, min(k, 50)))


def with_presence(refs: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """`refs` with `inside`: whether the index has the node."""
    known = nodes.select(F.col(node).cast("string").alias("ref"), F.lit(True).alias("_in")).distinct()
    return refs.join(known, "ref", "left").withColumn("inside", F.col("_in").isNotNull()).drop("_in")


def dangling(edges: DataFrame, kind: str, nodes: DataFrame, node: str) -> DataFrame:
    """n: distinct references of a kind that no node answers."""
    known = nodes.select(F.col(node).cast("string").alias("ref"))
    return edges.filter(F.col("kind") == kind).select("ref").distinct().join(known, "ref", "left_anti").agg(F.count("*").alias("n"))


def citing(edges: DataFrame, kind: str, ref: str, documents: DataFrame, source: str) -> DataFrame:
    """The documents that cite a reference under any court's name."""
    base = ref.split("/")[0].strip()
    hit = edges.filter((F.col("kind") == kind) & (base_ref(F.col("ref")) == base)).select(F.col("source").alias(source)).distinct()
    return documents.join(hit, source, "left_semi")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind", "ref").agg(F.count_distinct("source").alias("in_degree"))


def siblings(rows: DataFrame, group: str, node: str, most: int = 5) -> DataFrame:
    """node, others, more: up to `most` other nodes of the same group, and whether there are more.

    A group's first `most + 1` nodes serve all its nodes, so no group is paired with itself."""
    nodes = rows.select(group, node).distinct()
    nth = F.row_number().over(W.partitionBy(group).orderBy(node))
    first = nodes.withColumn("_n", nth).filter(F.col("_n") <= most + 1).groupBy(group).agg(F.sort_array(F.collect_list(node)).alias("_first"))
    sizes = nodes.groupBy(group).agg(F.count("*").alias("_size")).filter("_size > 1")
    others = F.slice(F.filter("_first", lambda x: x != F.col(node)), 1, most)
    return nodes.join(sizes, group).join(first, group).select(node, F.array_join(others, ",").alias("others"), (F.col("_size") - 1 > most).alias("more"))


def others(rows: DataFrame, group: str, node: str, of_group: str, of_node: str) -> DataFrame:
    """The other nodes of a group, in order: what an identifier may have been taken for."""
    return rows.filter((F.col(group).cast("string") == of_group) & (F.col(node).cast("string") != of_node)).orderBy(node)
