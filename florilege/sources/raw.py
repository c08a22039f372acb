"""Raw pages as gzip texts by name, the limits of packages (read in `bulletin`), and receipts as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.operators.parsers import next_page

#: The name of a raw page, `<issue>-<code>[.p<page>].html.gz`, and the limits of a package.
PAGE_NAME = r"(\d+)-(\d+)(?:\.p(\d+))?\.html\.gz$"
#: Names of what `write_pages` writes, and what ends a page in them.
WRITTEN_NAME = r"issue=(\d+)/code=(\d+)/page=(\d+)/part-[^/]*\.txt\.gz$"
PAGE_END = "\0"
ENTRY_MOST, PACKAGE_MOST = 64 << 20, 600 << 20
RECEIPT = (
    "acordao string, processo string, obtido_em string, url string, sha256 string, html string, id_documento string, nr_processo string, tribunal string, tipo string, "
    "data_julgamento string, orgao string, relator string, texto string, trechos_transcritos array<string>, trecho_divergente string, trechos_obiter array<string>, normalizacao string"
)


def page_columns(files: DataFrame) -> DataFrame:
    """issue, code, page, html of files of whole texts (`value`), by their names: single pages, or what `write_pages` wrote."""
    name = F.col("_name")
    single, written = (lambda k: F.regexp_extract(name, PAGE_NAME, k)), (lambda k: F.regexp_extract(name, WRITTEN_NAME, k))
    number = lambda k: F.coalesce(F.nullif(single(k), F.lit("")), F.nullif(written(k), F.lit(""))).cast("int")
    named = files.withColumn("_name", F.input_file_name()).filter(name.rlike(PAGE_NAME) | name.rlike(WRITTEN_NAME))
    html = F.when(F.col("value").endswith(PAGE_END), F.left("value", F.length("value") - 1)).otherwise(F.col("value"))
    return named.select(number(1).alias("issue"), number(2).alias("code"), F.coalesce(number(3), F.lit(1)).alias("page"), html.alias("html"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """issue, code, page, html of the raw pages under `path`."""
    return page_columns(spark.read.text(path, wholetext=True, recursiveFileLookup=True))


def consecutive(pages: DataFrame) -> DataFrame:
    """The pages of each section with `reason`: `gap` after its first missing page, else `incomplete` if the last page before that
    names a next one, else null."""
    section = W.partitionBy("issue", "code")
    run = pages.withColumn("_run", F.row_number().over(section.orderBy("page")) == F.col("page"))
    ended = next_page(F.max_by("html", F.when(F.col("_run"), F.col("page"))).over(section)).isNull()
    reason = F.when(~F.col("_run"), "gap").when(~ended, "incomplete")
    return run.withColumn("reason", reason).drop("_run")


def write_pages(pages: DataFrame, path: str) -> None:
    """The html of pages as gzip text, a folder a page; a page written before is replaced. `read_pages` reads it back."""
    once = pages.select("issue", "code", "page", "html").repartition("issue", "code", "page")
    text = once.write.option("compression", "gzip").option("lineSep", PAGE_END).option("partitionOverwriteMode", "dynamic")
    text.partitionBy("issue", "code", "page").mode("overwrite").text(path)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECEIPT).option("multiLine", True).json(path)
