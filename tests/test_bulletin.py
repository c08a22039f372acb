"""The data source of pages: folders, packages, pushed filters, the stream and the sink."""

import gzip
import hashlib
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from florilege.sources import bulletin, raw

TYPE = "issue int, code int, page int, html string"


def made(n=60):
    return [(i % 7, 5 + i % 2, i // 14 + 1, f"<p>página {i}</p>\n" * (i + 1)) for i in range(n)]


def tar_of(path, entries, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, content in entries:
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))


def named(row):
    return f"in/{row[0]}-{row[1]}.p{row[2]}.html.gz", gzip.compress(row[3].encode())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_a_folder_reads_as_before(spark, tmp_path):
    for row in made():
        name, content = named(row)
        (tmp_path / os.path.basename(name)).write_bytes(content)
    (tmp_path / "1-5.txt").write_text("no page")
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "9-9.html.gz").write_bytes(gzip.compress(b"x"))
    assert rows(bulletin.pages(spark, str(tmp_path))) == sorted(made())
    assert rows(raw.read_pages(spark, f"{tmp_path}/*.gz")) == sorted(made())
    raw.write_pages(spark.createDataFrame(made(), TYPE), str(tmp_path / "w"))
    assert rows(bulletin.pages(spark, f"file://{tmp_path}/w")) == sorted(made())


def test_packages_plain_and_compressed(spark, tmp_path):
    entries = [named(r) for r in made()] + [("../8-5.html.gz", b"z"), ("in/evil.sh", b"y")]
    for name, mode in (("a.tar", "w"), ("a.tar.gz", "w:gz"), ("a.tar.xz", "w:xz")):
        tar_of(tmp_path / name, entries, mode)
        read = bulletin.registered(spark).read.format("bulletin").option("share_bytes", 400)
        frame = read.load(str(tmp_path / name))
        assert rows(frame) == sorted(made()), name
        # a plain package is read by several tasks, each its share of the members
        tasks = frame.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks == 1 if mode != "w" else tasks > 5
    blob = (tmp_path / "a.tar").read_bytes()
    right, wrong = hashlib.sha256(blob).hexdigest(), "0" * 64
    assert rows(bulletin.entries(spark, str(tmp_path / "a.tar"), right)) == sorted((n.rsplit("/", 1)[-1], c) for n, c in entries[:-2])
    with pytest.raises(Exception, match="hash"):
        bulletin.entries(spark, str(tmp_path / "a.tar"), wrong).collect()


@pytest.mark.parametrize("condition", ["issue = 3", "issue IN (1, 4) AND code >= 6", "page > 2 AND issue < 5 AND html LIKE '%5%'", "issue = 99", "issue IS NULL", "code <=> 5"])
def test_filters_are_decided_by_names(spark, tmp_path, condition):
    tar_of(tmp_path / "a.tar", [named(r) for r in made()])
    frame = bulletin.pages(spark, str(tmp_path)).filter(condition)
    assert rows(frame) == rows(spark.createDataFrame(made(), TYPE).filter(condition))


def test_a_pruned_page_is_never_opened(spark, tmp_path):
    """Pages of other issues are not gzip at all: reading one would raise."""
    tar_of(tmp_path / "a.tar", [("1-5.html.gz", gzip.compress(b"good")), ("2-5.html.gz", b"broken")])
    (tmp_path / "3-5.html.gz").write_bytes(b"broken")
    frame = bulletin.pages(spark, str(tmp_path)).filter("issue = 1")
    assert rows(frame) == [(1, 5, 1, "good")]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # the source has taken it over
    with pytest.raises(Exception, match="gzip"):
        bulletin.pages(spark, str(tmp_path)).collect()


def test_limits_are_read_from_headers(spark, tmp_path):
    """A header that announces too much: no byte of the member is there, so only the header can have been read."""
    info = tarfile.TarInfo("1-5.html.gz")
    info.size = raw.ENTRY_MOST + 1
    for name, opened in (("a.tar", open), ("a.tar.gz", gzip.open)):
        with opened(tmp_path / name, "wb") as f:
            f.write(info.tobuf())
        with pytest.raises(Exception, match="limits"):
            bulletin.entries(spark, str(tmp_path / name)).collect()
    with pytest.raises(Exception, match="nowhere"):
        bulletin.pages(spark, str(tmp_path / "nowhere")).collect()


def test_sink(spark, tmp_path):
    out = str(tmp_path / "out")
    frame = spark.createDataFrame([*made(), (90, 1, 1, None), (90, 1, 2, "")], TYPE).repartition(3)
    bulletin.write_packages(frame, out, package_bytes=400)
    packages = os.listdir(out)
    assert sum(p.endswith(".tar") for p in packages) > 3
    want = sorted([*made(), (90, 1, 1, ""), (90, 1, 2, "")])
    assert rows(bulletin.pages(spark, out)) == want
    bulletin.write_packages(spark.createDataFrame([(91, 1, 1, "x")], TYPE), out)
    assert rows(bulletin.pages(spark, out)) == sorted([*want, (91, 1, 1, "x")])
    # a job that fails leaves what was there
    with pytest.raises(Exception, match="has no name"):
        bulletin.write_packages(spark.createDataFrame([(92, 1, 1, "y"), (None, 1, 1, "z")], TYPE), out, "overwrite")
    assert bulletin.pages(spark, out).count() == len(want) + 1
    bulletin.write_packages(spark.createDataFrame([(93, 1, 1, "w")], TYPE), out, "overwrite")
    assert rows(bulletin.pages(spark, out)) == [(93, 1, 1, "w")]
    bulletin.write_packages(spark.createDataFrame([], TYPE), out, "overwrite")
    assert rows(bulletin.pages(spark, out)) == []


def test_stream_takes_what_is_new(spark, tmp_path):
    """Pages, then a package, then a page written anew; a run without news has no rows, and a file just written waits."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run(settle=0, checkpoint="c", out=out):
        stream = bulletin.registered(spark).readStream.format("bulletin").option("settle", settle).load(str(source))
        started = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert started.awaitTermination(120)
        return rows(spark.read.schema(TYPE).parquet(str(out)))

    (source / "1-5.html.gz").write_bytes(gzip.compress(b"one"))
    first = [(1, 5, 1, "one")]
    assert run() == first and run() == first
    tar_of(source / "b.tar", [named(r) for r in made(9)])
    assert run(3600, "patient", tmp_path / "none") == []
    (source / "1-5.html.gz").unlink()  # what has been read may go
    assert run() == sorted(first + made(9))
    (source / "1-5.html.gz").write_bytes(gzip.compress(b"two"))
    assert run() == sorted([*first, *made(9), (1, 5, 1, "two")])
