"""Keyed tables: upserts where the first arrival stays, republications, deletes that follow, receipts with their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: str, arrival: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that came later under a known key), by the order of arrival."""
    numbered = rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*arrival)))
    return numbered.filter("_n = 1").drop("_n"), numbered.filter("_n > 1").drop("_n")


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or replace: the new rows, and the old ones under other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def inserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: the old rows, and one new row for each other key."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def deleted(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each table (with its column of that key) less the rows of the deleted keys."""
    return {name: t.join(gone.select(F.col(key).alias(column)).distinct(), column, "left_anti") for name, (t, column) in tables.items()}


def receipts(rows: DataFrame, key: str, content: str) -> DataFrame:
    return rows.select(F.col(key), F.sha2(F.col(content), 256).alias("sha256"))


def checked(receipts_: DataFrame, content: str = "html", sha256: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """(receipts whose hash is that of their content, receipts to quarantine)."""
    good = F.coalesce(F.sha2(F.col(content), 256) == F.col(sha256), F.lit(False))
    return receipts_.filter(good), receipts_.filter(~good)


def migrated(receipts_: DataFrame, derive: dict) -> DataFrame:
    """Receipts with derived fields made anew, and `changed`, whether any of them differed. `derive` is name -> Column."""
    changed = F.lit(False)
    for name, column in derive.items():
        changed = changed | (~F.col(name).eqNullSafe(column) if name in receipts_.columns else F.lit(True))
    return receipts_.withColumn("changed", changed).withColumns(derive)


def recent_marks(marks: DataFrame, prefix: str, since: float) -> DataFrame:
    """Rows (key, value) of a key's prefix whose value, read as a number, is above `since`; what is no number is 0."""
    number = F.coalesce(F.col("value").try_cast("double"), F.lit(0.0))
    return marks.filter(F.col("key").startswith(prefix) & (number > since))
