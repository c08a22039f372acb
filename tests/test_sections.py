"""Ingestion with each section's state: equal to the batch for every split, resumed, retried, forgotten."""

import gzip
import os
import random
import time

import pandas as pd
import pytest

from florilege.plans import fixtures
from florilege.sources import bulletin
from florilege.streaming import ingest, sections

KNOWN = [5, 6, 7, 8]
NEXT = "submitWIGrid('f',1001)\" class='nav_go'</table>"
TYPE = "issue int, code int, page int, html string"


def page(*numbers, more=False, head=None):
    cells = "".join(fixtures.CELL.format(decision=f"2026{n:04}", process=f"20260000{n:04}", cls="{cls}", abstract=f"Sobre {n}.\nTema {n + 1}.") for n in numbers)
    first, _, rest = cells.partition("{cls}")
    body = f"{first}{head}{rest}" if head else cells.split("</tr>", 1)[1] if numbers else ""
    return f"<table>{body.replace('{cls}', head or '')}</table>" + (NEXT if more else "")


#: Sections of three pages with a class that goes on, one that repeats a page, one with a gap, one without its end, one cut, one empty, one unknown.
FILES = [
    (1, 5, 1, page(1, 2, more=True, head="Apelação")), (1, 5, 2, page(3, more=True)), (1, 5, 3, page(4, head="Agravo")),
    (1, 6, 1, page(5, more=True, head="Apelação")), (1, 6, 2, page(5, more=True, head="Apelação")),
    (1, 7, 1, page(6, head="Apelação")), (1, 7, 3, page(7)),
    (2, 5, 1, page(8, more=True, head="Apelação")),
    (2, 6, 1, "<table>cut"), (2, 7, 1, page()), (2, 99, 1, page(9, head="Apelação")), (2, 8, 1, page(10, head="Habeas Corpus")), (3, 8, 1, page(11, head="Habeas Corpus")),
]


def name(issue, code, number):
    return f"{issue}-{code}{f'.p{number}' if number > 1 else ''}.html.gz"


def write(folder, rows, start):
    for k, (issue, code, number, html) in enumerate(rows):
        path = folder / name(issue, code, number)
        path.write_bytes(gzip.compress(html.encode()))
        os.utime(path, (start + k, start + k))


def rows_of(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def run(spark, source, tmp, size=14, **times):
    q = sections.watch(sections.file_pages(spark, str(source), size), str(tmp / "out"), str(tmp / "c"), KNOWN, **times)
    assert q.awaitTermination(60)
    return q


def same(spark, tmp, pages):
    want, got = ingest.tables(spark.createDataFrame(pages, TYPE), KNOWN), sections.ingested(spark, str(tmp / "out"))
    assert set(want) == set(got)
    for table, frame in want.items():
        assert rows_of(got[table]) == rows_of(frame.drop("html") if table == "rejects" else frame), table
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_every_split_ends_in_the_batch(spark, tmp_path, seed):
    """Files in any order, few at a time, over two runs of the stream; then pages that complete, replace and mend."""
    source, draw = tmp_path / "in", random.Random(seed)
    source.mkdir()
    files = draw.sample(FILES, len(FILES))
    half = draw.randint(2, len(files) - 2)
    write(source, files[:half], 1_700_000_000)
    run(spark, source, tmp_path, draw.randint(3, 6))
    write(source, files[half:], 1_700_000_100)
    run(spark, source, tmp_path, draw.randint(3, 6))
    got = same(spark, tmp_path, FILES)
    assert [r["class"] for r in got["decisions"].filter("issue = 1 AND code = 5").orderBy("decision").collect()] == ["Apelação", "Apelação", "Apelação", "Agravo"]
    later = [(2, 5, 2, page(12)), (1, 7, 2, page(14, more=True))]
    again = [(1, 6, 2, page(13)), (2, 6, 1, page(15, head="Agravo")), (1, 7, 1, page(6, more=True, head="Agravo"))]
    write(source, later, 1_700_000_200)
    (source / "again").mkdir()
    write(source / "again", again, 1_700_000_300)
    q = sections.watch(sections.file_pages(spark, f"{source}/{{*.gz,again/*.gz}}"), str(tmp_path / "out"), str(tmp_path / "c"), KNOWN)
    assert q.awaitTermination(60)
    # only what is new was read
    assert sum(p.numInputRows for p in q.recentProgress) == len(later) + len(again)
    replaced = {r[:3] for r in again}
    got = same(spark, tmp_path, [r for r in FILES if r[:3] not in replaced] + later + again)
    assert got["decisions"].count() == 14


def test_empty_sections_are_due_and_states_go(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, [(2, 7, 1, page()), (2, 8, 1, page(10, head="Agravo"))], 1_700_000_000)
    run(spark, source, tmp_path, retry_ms=1, keep_ms=3_600_000)
    kinds = lambda: {(r.code, r.kind) for r in sections.current(spark, str(tmp_path / "out")).collect()}
    assert kinds() >= {(7, "empty"), (8, "item")}
    time.sleep(1)
    write(source, [(3, 8, 1, page(11, head="Agravo"))], 1_700_000_100)
    run(spark, source, tmp_path, retry_ms=1, keep_ms=1)
    assert (7, "due") in kinds() and (8, "due") not in kinds()
    time.sleep(1)
    # the section that has come by then is no longer due; the state of issue 3 went, so its second page stands alone
    for k, row in enumerate([(2, 7, 2, page(20, head="Agravo")), (3, 8, 2, page(21))]):
        write(source, [row], 1_700_000_200 + k)
        run(spark, source, tmp_path, retry_ms=1, keep_ms=3_600_000)
    got = {(r.issue, r.code, r.kind, r.reason) for r in sections.current(spark, str(tmp_path / "out")).filter("kind <> 'touched'").collect()}
    assert {(2, 7, "item", None), (3, 8, "refused", "gap")} <= got and not [g for g in got if g[:2] == (2, 7) and g[2] == "due"]


def test_what_is_pending(spark):
    made = [("touched", 3, 5, 1), ("item", 3, 5, 1), ("touched", 3, 6, 1), ("empty", 3, 6, 1), ("touched", 3, 7, 1), ("empty", 3, 7, 1), ("due", 3, 7, 4), ("touched", 2, 5, 2), ("refused", 2, 5, 2)]
    out = spark.createDataFrame(made, "kind string, issue int, code int, batch long")
    expected = spark.createDataFrame([(3, 5), (3, 6), (3, 7), (3, 8), (2, 5), (2, 5)], "issue int, code int")
    issues = spark.createDataFrame([(3,), (2,), (1,)], "issue int")
    got = [tuple(r) for r in sections.pending(expected, out, issues).collect()]
    assert got == [(3, 6, "waiting"), (3, 7, "due"), (3, 8, "new"), (2, 5, "refused"), *[(1, None, "menu")] * sections.USUAL_SECTIONS]


def test_pages_of_packages(spark, tmp_path):
    """The stream of the data source brings sections in from packages."""
    bulletin.write_packages(spark.createDataFrame(FILES, TYPE).repartition(3), str(tmp_path / "in"))
    stream = bulletin.registered(spark).readStream.format("bulletin").option("settle", 0).load(str(tmp_path / "in"))
    assert sections.watch(stream, str(tmp_path / "out"), str(tmp_path / "c"), KNOWN).awaitTermination(60)
    same(spark, tmp_path, FILES)


def test_workers_get_pages_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Neither the sink nor the stream hands a worker more than a few MB at once, and the session's settings stay."""
    large = [(1, 5, n, page(n, more=n < 12, head=f"Apelação {'x' * 1_000_000}")) for n in range(1, 13)]

    class Bounded(bulletin.Packer):
        def write(self, batches):
            return super().write(b for b in batches if b.nbytes < 6_000_000 or 1 / 0)

    class Source(bulletin.Bulletin):
        def writer(self, schema, overwrite):
            return Bounded(self.options, overwrite)

    class Frames(sections.Sections):
        def handleInputRows(self, key, rows, timerValues):
            frames = [*rows]
            yield from super().handleInputRows(key, iter(frames), timerValues)
            yield pd.DataFrame([("frames", *key, len(frames), None, *(None,) * len(sections.ITEM_NAMES))], columns=sections.CHANGE_NAMES)

    before = {s: spark.conf.get(s) for s in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")}
    monkeypatch.setattr(bulletin, "Bulletin", Source)
    bulletin.write_packages(spark.createDataFrame(large, TYPE).repartition(1), str(tmp_path / "in"))
    monkeypatch.undo()
    monkeypatch.setattr(sections, "Sections", Frames)
    stream = bulletin.registered(spark).readStream.format("bulletin").option("settle", 0).load(str(tmp_path / "in"))
    assert sections.watch(stream, str(tmp_path / "out"), str(tmp_path / "c"), KNOWN).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.filter("kind = 'frames'").first()["page"] > 2
    assert rows.filter("kind = 'item'").count() == 12
    assert before == {s: spark.conf.get(s) for s in before}
