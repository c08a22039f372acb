"""The corpus pipeline over `documents`: every stage reads the table that its predecessor wrote.

Language ID drops documents without a told language; exact dedup keeps the row of largest doc_id of equal texts; SimHash
near-dedup keeps the smallest doc_id of each component; mixing repeats and drops documents to meet the sources' targets and
puts them in training order (a pass that takes under half of a document's words is left out, any other has the whole
text); the last stage encodes what is left. Nulls, empty texts, ties and empty tables follow the operators' docstrings.

Stages 2 to 4 decide by row: a row is known by its file and its place in it, or, where the input is not a table just read, by
a number with which the stage writes it first; rows are kept or placed by that. A doc_id is only
a rank, null after all others: of rows that repeat one, and of rows without one, a group of copies keeps a single row (the
exact one the last, the near one the first), and each row is mixed by itself. Columns that
the stages add have names that the documents do not have, so other columns pass through whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm import crossparse, curriculum, exact_dedup, simhash, viterbi
from florilege.llm.shared import forget, kept, materialize, scratch_tables, table

#: The stages pick representatives by fingerprint components and encode with a tokenizer: not for SQL.
ORACLE_SQL = None


def free_name(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """`docs` with what names a row at every reading, and its column: of files their path, by 96 bits of hashes, and the row's
    place; else a number, written with the rows."""
    row = free_name(docs, "row_number")
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" and "_metadata" not in docs.columns:
        file = F.col("_metadata.file_path")
        return docs.withColumn(row, F.struct(F.xxhash64(file).alias("file"), F.hash(file).alias("check"), F.col("_metadata.row_index").alias("at"))), row
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), tag), row


def without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """`docs` less the rows of these numbers. Written first, so their size is known when the join is planned."""
    return docs.join(materialize(dropped.select(row), "dropped"), row, "left_anti").drop(row)


def told_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return crossparse.keep_known(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = numbered(docs, "rows")
    keyed = docs.select("text", F.struct("doc_id", F.col(row).alias("row")).alias("key"))
    return without(docs, exact_dedup.exact_dedup(keyed, "key").filter("NOT kept").select(F.col("doc_id.row").alias(row)), row)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, row = numbered(docs, "rows")
    found = simhash.near_duplicates(docs, row).select(F.col("doc_id").alias("row"), "component_id")
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    found = materialize(found.join(ids, "row"), "components")
    best = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "row")).alias("best"))
    return without(docs, found.join(best.select("best.row"), "row", "left_anti").withColumnRenamed("row", row), row)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    columns = docs.columns
    docs, row = numbered(docs, "rows")
    place = free_name(docs, "place")
    rows = curriculum.placed(docs.select("doc_id", "text", "source", row), row=row)
    passes = [F.struct(F.lit(p).alias("pass"), curriculum.words_of_pass(p).alias("words"), curriculum.position_of_pass(p).alias("position")) for p in range(curriculum.MAX_EPOCHS)]
    rows = rows.select(row, "size", F.inline(F.array(*passes))).filter("words > 0 AND 2 * words >= size")
    plan = materialize(rows.select(row, F.struct("position", "pass").alias(place)), "plan")
    return docs.join(plan, row).orderBy(f"{place}.position", "doc_id", f"{place}.pass", row).select([F.col(f"`{c}`") for c in columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return viterbi.encode(docs)


STAGES = [
    ("language ID", told_language),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", distinct_fingerprints),
    ("mixing sources", mixed),
    ("SentencePiece encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself goes when its output is written, which goes when the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch_tables(spark):
            docs = kept(materialize(stage(spark, docs, sf_dir), name.split()[0].lower()))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
