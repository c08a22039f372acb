"""Ingestion with the state of each section kept by Spark: a page is parsed once, before the shuffle, and never read again.

`summaries` makes of a page what its section needs of it: digest, whether it is cut off and whether another follows, its decisions,
and the class in force at its end (empty: the one before goes on). A section's state is the summaries of its pages, so no html is shuffled
or kept. A batch answers for each section it brought pages of, wholly: its decisions if it is whole, and why pages were refused.
Everything follows from the pages so far, so any split of them into batches ends in the same tables, those of `ingest.tables`.

A whole section without a decision may be an error page: it is reported `empty`, and `due` RETRY_DAYS after its last page, unless it has
decisions by then. KEEP_DAYS after its last page a section's state goes; a page that comes later begins it anew.
Pages of one number in one batch: the one whose digest is last counts, as nothing says which came last. A null page is an empty one."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from florilege.functions import workers
from florilege.operators import parsers
from florilege.sources.raw import page_columns
from florilege.streaming.ingest import PARSER_VERSION, tables_of

#: When an empty section is asked for again. Then how long a section's state is kept, and how many sections an unseen issue counts for.
RETRY_DAYS, KEEP_DAYS, USUAL_SECTIONS = 7, 90, 5
DAY_MS = 86_400_000
SUMMARY = "digest string, cut boolean, more boolean, ends string, items string"
ITEM_NAMES = [c.split()[0] for c in parsers.SECTION_ITEM.split(", ")]
CHANGE = f"kind string, issue int, code int, page int, reason string, {parsers.SECTION_ITEM}"
CHANGE_NAMES = [c.split()[0] for c in CHANGE.split(", ")]
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def summaries(pages: DataFrame) -> DataFrame:
    """issue, code, page and the summary of each page."""
    html = F.coalesce("html", F.lit(""))
    cut = ~F.lower(F.right(html, F.lit(400))).contains("</table>")
    rows = pages.select("issue", "code", "page", F.sha2(html, 256).alias("digest"), cut.alias("cut"), parsers.next_page(html).isNotNull().alias("more"), html.alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parsers.section(h) for h in b.column("html").to_pylist()]
            made = [pa.array([c for _, c in parsed], pa.string()), pa.array([json.dumps(i, ensure_ascii=False) for i, _ in parsed], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "ends", "items"])
        workers.give_back()

    return rows.mapInArrow(run, f"issue int, code int, page int, {SUMMARY}")


def judged(pages: dict[int, tuple], known: bool) -> tuple[list[int], dict[int, str]]:
    """Of a section's summaries: the pages of a whole section in order, and why the others do not go on."""
    copies = Counter(digest for digest, *_ in pages.values())
    why = {n: "unknown section" if not known else "truncated" if cut else "repeated" for n, (digest, cut, *_) in pages.items() if not known or cut or copies[digest] > 1}
    good = sorted(pages.keys() - why.keys())
    run = [n for k, n in enumerate(good, 1) if n == k]
    why |= dict.fromkeys(good[len(run) :], "gap")
    if run and pages[run[-1]][2]:  # its last page names another
        why |= dict.fromkeys(run, "incomplete")
        run = []
    return run, why


def decisions(pages: dict[int, tuple], run: list[int]) -> list[tuple]:
    """The decisions of pages in order, each once; a class goes on until the next is named."""
    found: dict[str, tuple] = {}
    current = ""
    for n in run:
        *_, last, items = pages[n]
        for decision, process, named, *rest in json.loads(items):
            found.setdefault(decision, (decision, process, named or current, *rest))
        current = last or current
    return list(found.values())


class Sections(StatefulProcessor):
    def __init__(self, known_codes: list[int], retry_ms: int, keep_ms: int):
        self.known, self.retry_ms, self.keep_ms = frozenset(known_codes), retry_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", SUMMARY)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        issue, code = key
        new = pd.concat(list(rows)).sort_values(["page", "digest"])
        for row in new.drop_duplicates("page", keep="last").itertuples(index=False):
            self.pages.updateValue((int(row.page),), (row.digest, bool(row.cut), bool(row.more), row.ends, row.items))
        pages = {n: tuple(summary) for (n,), summary in self.pages.iterator()}
        run, why = judged(pages, code in self.known)
        items = decisions(pages, run)
        now = timerValues.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.keep_ms)
        if empty := bool(run) and not items:
            self.due.update((now + self.retry_ms,))
            self.handle.registerTimer(now + self.retry_ms)
        elif self.due.exists():
            self.due.clear()
        made = [("touched", 0, None), *[("empty", 0, None)] * empty, *(("refused", n, why[n]) for n in sorted(why))]
        none = (None,) * len(ITEM_NAMES)
        changes = [(kind, issue, code, page, reason, *none) for kind, page, reason in made] + [("item", issue, code, 0, None, *item) for item in items]
        yield pd.DataFrame(changes, columns=CHANGE_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.due.exists() and self.due.get()[0] == at:
            self.due.clear()
            yield pd.DataFrame([("due", *key, 0, None, *(None,) * len(ITEM_NAMES))], columns=CHANGE_NAMES)
        else:
            self.pages.clear()
            self.due.clear()

    def close(self) -> None:
        workers.give_back()


def changes(pages: DataFrame, known_codes: list[int], retry_ms: int = RETRY_DAYS * DAY_MS, keep_ms: int = KEEP_DAYS * DAY_MS) -> DataFrame:
    """What a stream of pages changes, a batch at a time (CHANGE): sections touched, their decisions, pages refused, sections empty and due."""
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keyed = summaries(pages).groupBy("issue", "code")
    return keyed.transformWithStateInPandas(Sections(known_codes, retry_ms, keep_ms), CHANGE, "Update", "ProcessingTime")


def watch(pages: DataFrame, out: str, checkpoint: str, known_codes: list[int], parts: int | None = None, **times: int):
    """The changes of a stream of pages (`pages`, from files or packages) under `out`, by batch, written once each.

    Times run out in batches with pages: batches without would follow one another for as long as a time is set. `parts` is how many
    shares the states have for the life of the checkpoint (else the session's shuffle partitions)."""

    def batch(frame: DataFrame, number: int) -> None:
        frame.write.mode("overwrite").partitionBy("kind").parquet(f"{out}/batch={number}")

    made = changes(pages, known_codes, **times).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    spark = pages.sparkSession
    settings = {NO_DATA: "false"} | workers.small_batches(spark) | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    with workers.held(spark, settings):  # the stream keeps the settings of its start
        return made.start()


def file_pages(spark: SparkSession, path: str, files_per_trigger: int = 14) -> DataFrame:
    """A stream of pages in files of their own, so many a batch. It knows files by path, so one written anew is not read again (for a week);
    the stream of format `bulletin` does so, and reads packages too."""
    return page_columns(spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True))


def current(spark: SparkSession, out: str) -> DataFrame:
    """The changes that stand, with `batch`: of each section those of the last batch that touched it, and whether it is due since."""
    rows = spark.read.schema(f"{CHANGE}, batch long").parquet(out)
    # `kind` is a folder, so this reads no decisions
    last = rows.filter("kind = 'touched'").groupBy("issue", "code").agg(F.max("batch").alias("last"))
    return rows.join(last, ["issue", "code"]).filter("batch >= last").drop("last")


def ingested(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The six tables of what has come so far; rejects by page and reason, without their html. Of a decision in several issues the first to arrive stays."""
    rows = current(spark, out)
    first = spark.read.schema(f"{CHANGE}, batch long").parquet(out).filter("kind = 'item'").groupBy("issue", "decision").agg(F.min("batch").alias("arrived"))
    items = rows.filter("kind = 'item'").select("issue", "code", *ITEM_NAMES).withColumn("parser", F.lit(PARSER_VERSION)).join(first, ["issue", "decision"])
    made = tables_of(items, rows.filter("kind = 'refused'").select("issue", "code", "page", "reason"), ["arrived", "issue", "code"])
    return made | {"decisions": made["decisions"].drop("arrived")}


def pending(expected: DataFrame, out: DataFrame, issues: DataFrame) -> DataFrame:
    """issue, code, why of the sections to ask for next, newest issue first: those that menus name (`expected`: issue, code) and that are not in.

    `out` is what stands (`current`). An empty section waits until it is due, and is `waiting`; an issue whose menu is not known counts USUAL_SECTIONS of unknown code.
    A budget is a limit on the rows that are not waiting, and the estimate of what remains is their number."""
    state = out.groupBy("issue", "code").agg(F.count_if(F.col("kind") == "item").alias("items"), F.max(F.struct(F.col("batch"), (F.col("kind") == "due").alias("due"))).alias("s"), F.count_if(F.col("kind") == "empty").alias("empties"))
    why: Column = F.when(F.col("empties") > 0, F.when(F.col("s.due"), "due").otherwise("waiting")).when(F.col("items").isNull(), "new").when(F.col("items") == 0, "refused")
    named = expected.select("issue", "code").distinct().join(state, ["issue", "code"], "left").withColumn("why", why).filter("why IS NOT NULL").select("issue", "code", "why")
    unseen = issues.select("issue").distinct().join(expected, "issue", "left_anti").select("issue", F.explode(F.array_repeat(F.lit(None).cast("int"), USUAL_SECTIONS)).alias("code"), F.lit("menu").alias("why"))
    return named.unionByName(unseen).orderBy(F.desc("issue"), F.asc_nulls_last("code"))
