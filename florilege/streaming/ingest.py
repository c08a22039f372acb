"""From raw pages to tables: bronze (pages), silver (decisions), gold (fields, edges); in one job, or as a stream of files.

The stream's checkpoint gives resumption, `maxFilesPerTrigger` its budget. Its pages are kept as they came; a batch parses
anew each section that it brought pages of, from all its pages so far, so a section may come in over several batches. What a
batch makes is written under its number, which makes it idempotent; `ingested` reads the latest of each section, and of a
decision in several issues the one that came first. A section that is not whole, repeats a page, has a page after a gap or
holds no decision goes to the rejects, not to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.operators import parsers, scratch, store
from florilege.sources.raw import consecutive, page_columns

PARSER_VERSION = 1
REFUSALS = ("truncated", "repeated", "incomplete", "gap", "unknown section")


def refusal(known_codes: list[int]) -> Column:
    """Why a page does not go on: null if it does."""
    html = F.col("html")
    return (
        F.when(~F.col("code").isin(known_codes), "unknown section")
        .when(~F.lower(F.right(html, F.lit(400))).contains("</table>"), "truncated")
        .when(F.col("_copies") > 1, "repeated")
    )


def sifted(pages: DataFrame, known_codes: list[int]) -> tuple[DataFrame, DataFrame]:
    """(pages of whole sections, rejects with their reason)."""
    digest = pages.withColumn("_digest", F.sha2("html", 256))
    copies = digest.groupBy("issue", "code", "_digest").agg(F.count("*").alias("_copies"))
    judged = digest.join(copies, ["issue", "code", "_digest"]).withColumn("reason", refusal(known_codes)).drop("_digest", "_copies")
    good, bad = judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")
    run = consecutive(good)
    return run.filter("reason IS NULL").drop("reason"), bad.unionByName(run.filter("reason IS NOT NULL"))


def decisions_of(pages: DataFrame) -> DataFrame:
    return parsers.section_rows(pages, ["issue", "code"])


def tables(pages: DataFrame, known_codes: list[int], newest_first: bool = False, keep_incomplete: bool = False) -> dict[str, DataFrame]:
    """decisions, republications, fields, edges, rejects, sections. Of a decision in several issues, the first to arrive stays.

    An import (`keep_incomplete`) takes sections whose end is missing too; they stay reported among the rejects."""
    whole, rejects = sifted(pages, known_codes)
    if keep_incomplete:
        whole = whole.unionByName(rejects.filter("reason = 'incomplete'").drop("reason"))
    order = [F.desc("issue") if newest_first else F.asc("issue"), "code"]
    # parsed once: all tables but the rejects come of these rows
    items = pages.sparkSession.read.parquet(scratch.written(decisions_of(whole).withColumn("parser", F.lit(PARSER_VERSION)), "items"))
    return tables_of(items, rejects, order)


def tables_of(rows: DataFrame, rejects: DataFrame, arrival: list) -> dict[str, DataFrame]:
    """The six tables from the decisions of whole sections, in their order of arrival."""
    decisions, republished = store.first_wins(rows, "decision", arrival)
    return {
        "decisions": decisions,
        "republications": republished.select("decision", "issue", "abstract"),
        "fields": parsers.with_fields(decisions.select("decision", "abstract"), "abstract").drop("abstract"),
        "edges": parsers.edges(decisions, "decision", "abstract"),
        "rejects": rejects,
        "sections": rows.groupBy("issue", "code").agg(F.count("*").alias("items")),
    }


def save(made: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet under `path`."""
    for name, frame in made.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def stale(decisions: DataFrame) -> DataFrame:
    """Decisions that another version of the parser made: their issues are to be parsed anew from the raw pages."""
    return decisions.filter(F.col("parser") != PARSER_VERSION).select("issue").distinct()


def watch(spark: SparkSession, path: str, out: str, checkpoint: str, known_codes: list[int], files_per_trigger: int = 14):
    """Stream new raw pages into `out`: each micro-batch keeps its pages and parses the sections they belong to, by batch id."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(path, wholetext=True)
    pages_type = "issue int, code int, page int, html string, batch long"

    def batch(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").partitionBy("issue").parquet(f"{out}/pages/batch={number}")
        issues = [r["issue"] for r in frame.select("issue").distinct().collect()]  # `files_per_trigger` at most
        # of the pages kept, those of these issues alone are read
        pages = spark.read.schema(pages_type).parquet(f"{out}/pages").filter((F.col("batch") <= number) & F.col("issue").isin(issues))
        touched = pages.filter(F.col("batch") == number).select("issue", "code").distinct()
        latest = W.partitionBy("issue", "code", "page").orderBy(F.desc("batch"))
        section = pages.join(touched, ["issue", "code"], "left_semi")
        # a page that came again replaces the one before; two in one batch are both kept, and rejected as repeated
        section = section.withColumn("_n", F.rank().over(latest)).filter("_n = 1").drop("_n", "batch")
        whole, rejects = sifted(section, known_codes)
        items = decisions_of(whole).withColumn("parser", F.lit(PARSER_VERSION))
        for name, rows in (("touched", touched), ("items", items), ("rejected", rejects)):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return page_columns(files).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The six tables of what `watch` has brought in so far."""
    read = {name: spark.read.parquet(f"{out}/{name}") for name in ("touched", "items", "rejected")}
    current = read["touched"].groupBy("issue", "code").agg(F.max("batch").alias("batch"))
    first = read["items"].groupBy("issue", "decision").agg(F.min("batch").alias("arrived"))
    items = read["items"].join(current, ["issue", "code", "batch"], "left_semi").join(first, ["issue", "decision"])
    made = tables_of(items, read["rejected"].join(current, ["issue", "code", "batch"], "left_semi").drop("batch"), ["arrived", "issue", "code"])
    return made | {"decisions": made["decisions"].drop("batch", "arrived")}
