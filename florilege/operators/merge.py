"""A keyed table brought up to date by a batch of rows, and what changed in it.

A key stands in one group at a time (a decision in the issue that printed it first). A batch may bring rows of new keys, new
rows of keys in their own group, which replace the old, and rows of keys in other groups, which are kept apart as
republications. Groups' sections that are done anew go first: what the batch does not bring back is deleted.

Old and new rows are tagged and brought together by one shuffle, by key; each key's rows tell its state and its change. What
depends on the table (parts, edges, index rows) follows from the change rows alone. Only partitions of groups that changed are
written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.operators import scratch

#: What `changes` says of a row: the first four are of the new state.
STATE = ("kept", "same", "inserted", "replaced")


def changes(old: DataFrame, new: DataFrame, key: str, group: str, arrival: list[str], anew: DataFrame | None = None) -> DataFrame:
    """The columns of `old`, and `change`: of the rows of the new state `kept`, `same` (written again as it was), `inserted`
    or `replaced`; beside them `republished` (a row a key and other group, the last to arrive) and `deleted` (old rows).

    `old` has one row a key. `new` has the same columns and those of `arrival`, by which its rows come; of a key that is new the
    first row says its group. `anew` names, by columns of `old`, the sections that the batch holds whole."""
    columns = old.columns
    value = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    going = F.lit(False)
    if anew is not None:
        by = [c for c in anew.columns if c in columns]
        old = old.join(anew.select(*by).distinct().withColumn("_anew", F.lit(True)), by, "left")
        going = F.coalesce("_anew", F.lit(False))
    kinds, places = dict(new.dtypes), [f"_at{i}" for i in range(len(arrival))]
    a = old.select(*columns, F.lit(0).alias("_side"), going.alias("_going"), *(F.lit(None).cast(kinds[c]).alias(at) for c, at in zip(arrival, places)))
    b = new.select(*columns, F.lit(1).alias("_side"), F.lit(False).alias("_going"), *(F.col(c).alias(at) for c, at in zip(arrival, places)))
    rows = a.unionByName(b).withColumn("_value", value)
    in_order = W.partitionBy(key).orderBy("_side", *places, "_value")
    whole = in_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumn("_nth", F.row_number().over(in_order))
    stays = ~F.col("_going")
    of_first = lambda when, value: F.first(F.when(when, value), ignorenulls=True).over(whole)
    rows = rows.withColumn("_holder", of_first(stays, F.struct(group)))
    at_home = F.col(group).eqNullSafe(F.col("_holder")[group])
    own = stays & at_home
    # a row that went, and whose key is now in another group, was deleted there and is new here
    rows = rows.withColumn("_before", of_first((F.col("_side") == 0) & at_home, F.col("_value")))
    rows = rows.withColumn("_last", F.last(F.when(own, F.col("_nth")), ignorenulls=True).over(whole))
    again = W.partitionBy(key, group).orderBy(F.desc("_nth"))
    rows = rows.withColumn("_late", F.row_number().over(again))
    is_state = F.col("_nth") == F.col("_last")
    change = (
        F.when(is_state & (F.col("_side") == 0), "kept")
        .when(is_state & F.col("_before").isNull(), "inserted")
        .when(is_state & (F.col("_before") == F.col("_value")), "same")
        .when(is_state, "replaced")
        .when((F.col("_side") == 0) & F.col("_going") & (F.col("_last").isNull() | ~at_home), "deleted")
        .when((F.col("_side") == 1) & ~own & (F.col("_late") == 1), "republished")
    )
    return rows.withColumn("change", change).filter("change IS NOT NULL").select(*columns, "change")


def state(changed: DataFrame) -> DataFrame:
    return changed.filter(F.col("change").isin(*STATE)).drop("change")


def republications(before: DataFrame, changed: DataFrame, key: str, group: str) -> DataFrame:
    """Rows of keys in other groups than their own: those of before, and the batch's, which take the place of earlier ones."""
    new = changed.filter("change = 'republished'").select(*before.columns)
    return before.join(new.select(key, group), [key, group], "left_anti").unionByName(new)


def dependants(table: DataFrame, changed: DataFrame, key: str, made: DataFrame, column: str | None = None) -> DataFrame:
    """`table`, whose `column` names the rows that it depends on, less what was made of rows that are no more, with `made` of the new ones."""
    gone = changed.filter("change IN ('replaced', 'deleted')").select(F.col(key).alias(column or key)).distinct()
    return table.join(gone, column or key, "left_anti").unionByName(made)


def fresh(changed: DataFrame) -> DataFrame:
    """The rows from which dependants are made."""
    return changed.filter("change IN ('inserted', 'replaced')").drop("change")


def write(changed: DataFrame, path: str, group: str) -> list:
    """Bring the table at `path`, partitioned by `group`, to its new state: groups without a change keep their files. The changed groups."""
    spark = changed.sparkSession
    changed = spark.read.parquet(scratch.written(changed, "changes"))  # it reads the files that are about to go
    touched = changed.filter("change IN ('inserted', 'replaced', 'deleted')").select(group).distinct()
    now = state(changed).join(touched, group, "left_semi")
    now.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)
    emptied = touched.join(now.select(group).distinct(), group, "left_anti")
    for r in emptied.toLocalIterator():  # groups without a row any more
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{group}={r[group]}")
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    return sorted(r[group] for r in touched.toLocalIterator())

