"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame functions only.

Each input partition is a lane that holds a run of digest entries. The lanes form a binomial tree: in the round of digit
r, a lane whose r-th digit (base `fan_in`) is not 0 passes its run to the one that has 0 there and the same higher digits,
which is left alone with `fan_in` runs. They are sorted by key and merged in one pass (Spark's sort aggregate, which merges
sorted runs from all senders; the aggregate holds a struct, which rules the hash aggregate out), and of equal entries one
verified identifier is kept. After log(lanes) / log(fan_in) rounds one lane is left. A lane is dealt over all partitions
by digest, so no task holds more than its share of the keys, and each round combines before it sends. With `fan_in` 2 the
rounds are those of a plain binomial tree; 4 takes two of its levels at a time, for half the shuffles. An entry's identity is
(SHA-256, byte length, XXH64); all three are compared at every level.

Defined results: a null text counts as empty; empty texts are equal to one another; of rows that repeat a doc_id and a text
one stays, the one that is last in the table as read; null doc_ids rank below all others and are kept only where a group
has no other; an empty table gives an empty result; other columns are never read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, materialize, salt, salt_mask, salted

LANES, FAN_IN = 256, 4
KEY = ("digest", "n_bytes", "witness")


def digest_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    return rows.select(
        "id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("witness"),
        F.monotonically_increasing_id().alias("row"),
        F.pmod(F.spark_partition_id(), F.lit(LANES)).alias("lane"),
    ).withColumn("part", salt(F.col("row")))


def merge_runs(entries: DataFrame, keep: str = "largest", lanes: int = LANES, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: the key, `keep_id` and `keep_row` that stay, `group_size`, and `mask` for `salted`."""
    pick = {"largest": F.max, "smallest": F.min}[keep]
    null_rank = F.col("id").isNotNull() if keep == "largest" else F.col("id").isNull()
    runs = entries.select(
        F.pmod("lane", F.lit(lanes)).alias("lane"),
        *KEY,
        F.struct(null_rank.alias("known"), F.col("id").alias("id"), F.col("row").alias("row")).alias("best"),
        F.lit(1).cast("long").alias("size"),
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("part")).alias("mask"),
    )
    digit = 1
    while digit < lanes:
        digit *= fan_in
        # the lane that has no digits below this one takes the runs of those that have
        owner = (F.col("lane") - F.pmod("lane", F.lit(digit))).alias("lane")
        runs = runs.groupBy(owner, *KEY).agg(pick("best").alias("best"), F.sum("size").alias("size"), F.bit_or("mask").alias("mask"))
    return runs.select(*KEY, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("size").alias("group_size"), "mask")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    entries = materialize(digest_entries(docs, id_col, text_col), "digests", narrow=True)
    groups = salted(merge_runs(entries, keep), "mask", "part")
    # a group of copies of any size is dealt over SALTS parts on both sides
    return entries.join(groups, [*KEY, "part"]).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS h, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept FROM t WINDOW w AS (PARTITION BY t))
SELECT doc_id, keep_id, group_size, kept, h AS text_sha256 FROM g
"""
