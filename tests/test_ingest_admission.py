"""Sources, ingestion in batch and as a stream, and admission in batch and as a stream."""

import gzip
import hashlib
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from florilege.plans import fixtures
from florilege.sources import bulletin, raw
from florilege.streaming import admission as A
from florilege.streaming import ingest


def write(folder, name, html):
    with gzip.open(folder / name, "wt", encoding="utf-8") as f:
        f.write(html)


NEXT = "submitWIGrid('f',1001)\" class='nav_go'</table>"


@pytest.fixture
def folder(tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    first, second = (p[3] for p in fixtures.section_pages())
    write(pages, "1-5.html.gz", first.replace("<br>", "<br>\n") + NEXT)  # a page has many lines
    write(pages, "1-5.p2.html.gz", second)
    write(pages, "2-5.html.gz", second)  # the same decision in a later issue
    write(pages, "2-6.html.gz", first + NEXT)  # its last page is missing
    write(pages, "2-99.html.gz", first)
    write(pages, "2-7.html.gz", "<table>cut")
    return pages


def test_batch(spark, folder):
    pages = raw.read_pages(spark, str(folder))
    assert pages.count() == 6
    made = ingest.tables(pages, [5, 6, 7])
    assert {r.decision for r in made["decisions"].collect()} == {"20261001", "20261002", "20261003"}
    assert [(r.decision, r.issue) for r in made["republications"].collect()] == [("20261003", 2)]
    assert {r.issue for r in ingest.tables(pages, [5, 6, 7], newest_first=True)["republications"].collect()} == {1}
    assert {(r.issue, r.code, r.reason) for r in made["rejects"].collect()} == {(2, 6, "incomplete"), (2, 99, "unknown section"), (2, 7, "truncated")}
    assert made["edges"].filter("kind = 'tjse'").count() == 1 and made["fields"].filter("tese <> ''").count() == 1
    assert ingest.stale(made["decisions"]).count() == 0


def rows_of(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


@pytest.mark.parametrize("files", [1, 14])
def test_stream_equals_batch_and_resumes(spark, folder, tmp_path, files):
    """All six tables, with a section whose pages come in different batches, and the second page first."""
    for k, name in enumerate(["1-5.p2.html.gz", "1-5.html.gz", "2-5.html.gz", "2-6.html.gz", "2-99.html.gz", "2-7.html.gz"]):
        os.utime(folder / name, (1_700_000_000 + k, 1_700_000_000 + k))
    out = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        ingest.watch(spark, str(folder), out, str(tmp_path / "checkpoint"), [5, 6, 7], files).awaitTermination(180)
    made, got = ingest.tables(raw.read_pages(spark, str(folder)), [5, 6, 7]), ingest.ingested(spark, out)
    assert set(got) == set(made)
    for name, rows in made.items():
        assert rows_of(got[name]) == rows_of(rows), name
    assert got["decisions"].count() == 3
    # the missing page of a section comes later, and a page comes again with other content
    write(folder, "2-6.p2.html.gz", fixtures.section_pages()[1][3].replace("20261003", "20269999"))
    write(folder, "2-7.html.gz", fixtures.section_pages()[1][3].replace("20261003", "20268888"))
    ingest.watch(spark, str(folder), out, str(tmp_path / "checkpoint"), [5, 6, 7], files).awaitTermination(180)
    got = ingest.ingested(spark, out)
    assert {r.decision for r in got["decisions"].collect()} == {"20261001", "20261002", "20261003", "20269999", "20268888"}
    assert {(r.issue, r.code, r.reason) for r in got["rejects"].collect()} == {(2, 99, "unknown section")}


def test_pages_after_a_gap_are_reported(spark, folder):
    write(folder, "2-5.p4.html.gz", fixtures.section_pages()[1][3].replace("20261003", "20267777"))
    made = ingest.tables(raw.read_pages(spark, str(folder)), [5, 6, 7])
    assert [(r.issue, r.code, r.page) for r in made["rejects"].filter("reason = 'gap'").collect()] == [(2, 5, 4)]
    assert {r.decision for r in made["decisions"].collect()} == {"20261001", "20261002", "20261003"}


def test_pages_written_are_read(spark, tmp_path):
    pages = spark.createDataFrame(fixtures.section_pages() + [(9, 1, 1, ""), (9, 1, 2, "two\nlines\n"), (9, 1, 3, "<p>\nthree\r\nlines\n\n</p>\n")], "issue int, code int, page int, html string")
    for _ in range(2):  # again replaces
        raw.write_pages(pages, str(tmp_path / "w"))
    raw.write_pages(pages.filter("issue = 9 AND page = 2").withColumn("html", F.lit("new")), str(tmp_path / "w"))
    want = sorted((r.issue, r.code, r.page, "new" if (r.issue, r.page) == (9, 2) else r.html) for r in pages.collect())
    assert sorted(map(tuple, raw.read_pages(spark, str(tmp_path / "w")).collect())) == want


def package(entries):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_package(spark, tmp_path):
    blob = package([("raw/1-5.html.gz", b"x"), ("raw/evil.sh", b"y"), ("../1-6.html.gz", b"z"), ("n" * 120 + "/2-5.p3.html.gz", b"w")])
    (tmp_path / "p.tar.gz").write_bytes(blob)
    got = bulletin.entries(spark, str(tmp_path / "p.tar.gz"), hashlib.sha256(blob).hexdigest()).collect()
    assert sorted((r.name, bytes(r.content)) for r in got) == [("1-5.html.gz", b"x"), ("2-5.p3.html.gz", b"w")]
    with pytest.raises(Exception, match="hash"):
        bulletin.entries(spark, str(tmp_path / "p.tar.gz"), "0" * 64).collect()


def test_receipts(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"acordao": "1", "html": "h", "trechos_obiter": ["a"]}))
    row = raw.read_receipts(spark, str(tmp_path / "r.json")).first()
    assert row.acordao == "1" and row.trechos_obiter == ["a"] and row.orgao is None


def test_ladder():
    s = A.State()
    assert A.asked(s, 0) == "admitted" and A.asked(s, 5) == "spacing" and A.asked(s, 6) == "admitted"
    s = A.State(requests=[float(t * 30) for t in range(20)])
    assert A.asked(s, 599) == "window" and A.asked(s, 601) == "admitted"
    A.answered(s, 601, "blocked")
    assert s.level == 1 and A.asked(s, 700) == "paused"
    for _ in range(A.CLEAN_TO_DESCEND):
        A.answered(s, 0, "ok")
    assert s.level == 0
    A.answered(s, 0, "timeout")
    assert s.level == 0 and s.reason == "blocked"
    assert A.asked(A.State(requests=[0.0] * A.DAY_MOST), 5000) == "day"
    for _ in range(9):
        A.answered(s, 0, "challenge")
    assert s.level == len(A.LADDER) - 1 and len(s.incidents) <= A.INCIDENTS_KEPT


def test_state_from_disk():
    assert A.restored(None, 0) == A.State()
    for text in ("garbage", "[]", '{"requests": "x"}', '{"requests": [1], "level": "q"}'):
        s = A.restored(text, 100)
        assert s.paused_until > 100 and s.level == len(A.LADDER) - 1
    s = A.restored('{"requests": [50, 999999, -99999], "level": 77, "clean": -3}', 100)
    assert s.requests == [50.0] and s.level == len(A.LADDER) - 1 and s.clean == 0


def test_responses():
    assert [A.classified(*a) for a in ((200,), (403,), (429,), (500,), (200, True), (0, False, True))] == ["ok", "blocked", "blocked", "error", "challenge", "timeout"]


def test_a_key_is_forgotten_after_long(spark):
    day = A.DAY_S
    log = [(1, 0.0, True), (1, 2.0 * day, False), (1, 31.9 * day, False), (1, 70.0 * day, False), (None, 5.0, False), (None, 6.0, False)]
    events = spark.createDataFrame([(k, t, r, n) for n, (k, t, r) in enumerate(log)], "k int, t double, r boolean, n long").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = {r.id: (r.decision, r.level) for r in A.replay(events, "k", "ts", F.col("r"), "n").collect()}
    assert got == {0: ("admitted", 1), 1: ("admitted", 1), 2: ("admitted", 1), 3: ("admitted", 0), 4: ("admitted", 0), 5: ("spacing", 0)}


def test_stream_lets_go_of_state(spark, tmp_path):
    """Two batches 40 days apart: the watermark passes the first key's time, and its state is removed."""
    base = "k int, ts timestamp, r boolean, n long"
    times = ["2026-01-01 00:00:00", "2026-02-20 00:00:00", "2026-02-20 00:00:30", "2026-02-20 00:01:00"]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(base).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for n, t in enumerate(times):
        spark.sql(f"SELECT {min(n, 1)} AS k, timestamp '{t}' AS ts, false AS r, {n}L AS n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = A.stream(stream, "k", "ts", F.col("r"), "n").writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(120)
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert rows[-1] == 1


def test_replay_equals_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type")
    refused = F.col("event_type") == "error"
    batch = sorted(map(tuple, A.replay(events, "user_id", "ts", refused, "event_id").collect()))
    events.coalesce(1).orderBy("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = A.stream(stream, "user_id", "ts", refused, "event_id").writeStream.format("memory").queryName("levels").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("levels").collect())) == batch
    assert {d for _, _, d, _ in batch} >= {"admitted", "paused"}
