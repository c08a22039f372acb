"""Raw pages as a data source, format `bulletin`: folders of pages, tar packages, a stream of either; and packages as a sink.

`load(path)` takes a folder, a page or a package. A row is a page (PAGES) or, with option `raw`, an allowed entry of a package
as its bytes (ENTRIES). Filters on issue, code and page are decided by names, before a page is opened.

- A package without compression is read member by member: its headers give places and sizes, and tasks read shares of them. A
  compressed one has no places; one task reads it as a stream. Both are checked for their limits by a member's header, before its
  bytes are loaded; option `sha256` is checked by a task of its own that reads the file in blocks.
- The stream's offset is a time: files last written before it have been read, whatever became of them. A file counts once it has been
  left alone for `settle` seconds (5; of one checkpoint never raised); a file written anew is read anew. The clocks of the driver and of
  what stores the files may differ by less than that. A replay after a stop reads the same files.
- Written packages hold pages as gzip members and roll over at `package_bytes`. A task's packages go to a folder of the job and
  are moved when all tasks are done, so a lost task or job leaves none. `overwrite` deletes the earlier ones after that.

Files or entries by other names, in hidden folders (`_`, `.`) or that lead upwards are not pages. Paths are those of pyarrow's
file systems, or local ones."""

from __future__ import annotations

import gzip
import hashlib
import io
import operator
import os
import re
import tarfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from florilege.functions import workers
from florilege.sources.raw import ENTRY_MOST, PACKAGE_MOST, PAGE_END, PAGE_NAME, WRITTEN_NAME

PAGES, ENTRIES = "issue int, code int, page int, html string", "name string, content binary"
PAGE_SCHEMA = pa.schema([("issue", pa.int32()), ("code", pa.int32()), ("page", pa.int32()), ("html", pa.string())])
ENTRY_SCHEMA = pa.schema([("name", pa.string()), ("content", pa.binary())])
PACKAGE_NAME = re.compile(r"\.(tar|tgz|tar\.(gz|bz2|xz))$")
UNFINISHED = "_unfinished"
BATCH_BYTES, BLOCK = 8 << 20, 1 << 20
#: Conditions that names decide, by their kind.
DECIDED: dict[type, Callable] = {
    ds.EqualTo: operator.eq,
    ds.GreaterThan: operator.gt,
    ds.GreaterThanOrEqual: operator.ge,
    ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le,
    ds.In: lambda value, among: value in among,
    ds.IsNotNull: lambda value, _: True,
}


def located(path: str) -> tuple[pfs.FileSystem, str]:
    if "://" in path:
        return pfs.FileSystem.from_uri(path)
    return pfs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def page_of(name: str) -> tuple[int, int, int] | None:
    """issue, code, page by a file's or an entry's name; None for what is no page."""
    m = re.search(rf"(?:^|/){PAGE_NAME}", name) or re.search(WRITTEN_NAME, name)
    return (int(m[1]), int(m[2]), int(m[3] or 1)) if m and ".." not in name.split("/") else None


@dataclass(frozen=True)
class Condition:
    column: str
    kind: type
    value: object = None

    def holds(self, page: tuple[int, int, int]) -> bool:
        return DECIDED[self.kind](page[("issue", "code", "page").index(self.column)], self.value)


@dataclass
class Files(ds.InputPartition):
    """Pages in files of their own."""

    paths: list[str]


@dataclass
class Members(ds.InputPartition):
    """A share of a package's members: (name, place, size)."""

    package: str
    members: list[tuple[str, int, int]]


@dataclass
class Packed(ds.InputPartition):
    """A compressed package."""

    package: str


@dataclass
class Hashed(ds.InputPartition):
    """A package whose hash was announced."""

    package: str
    sha256: str


def allowed(tar: tarfile.TarFile) -> Iterator[tarfile.TarInfo]:
    """The members that are pages, as their headers are read; the package's limits are checked there."""
    total = 0
    for entry in tar:
        if entry.isfile() and not entry.issparse() and page_of(entry.name):
            total += entry.size
            if entry.size > ENTRY_MOST or total > PACKAGE_MOST:
                raise ValueError(f"{entry.name}: the package is over its limits")
            yield entry


def shared(sized: list[tuple[object, int]], most: int) -> Iterator[list]:
    """Things with their sizes, in runs of about `most` bytes."""
    ahead = accumulate((size for _, size in sized), initial=0)
    for _, run in groupby(zip(sized, ahead), key=lambda x: x[1] // most):
        yield [thing for (thing, _), _ in run]


def html_of(content: bytes, name: str) -> str:
    text = gzip.decompress(content).decode("utf-8", "replace")
    return text.removesuffix(PAGE_END) if re.search(WRITTEN_NAME, name) else text


class Shares:
    """What is common to reading at once and as a stream: from files to shares, and from a share to its rows."""

    def __init__(self, options: dict[str, str]):
        self.path, self.raw, self.sha256 = options["path"], options.get("raw", "false").lower() == "true", options.get("sha256")
        self.share_bytes, self.settle = int(options.get("share_bytes", 32 << 20)), float(options.get("settle", 5))
        self.conditions: list[Condition] = []

    def asked(self, name: str) -> bool:
        page = page_of(name)
        return page is not None and all(c.holds(page) for c in self.conditions)

    def files(self) -> list[pfs.FileInfo]:
        """Pages and packages under the path, by name."""
        system, path = located(self.path)
        found = system.get_file_info(path)
        if found.type == pfs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if found.type == pfs.FileType.File:
            return [found]
        under = [f for f in system.get_file_info(pfs.FileSelector(path, recursive=True)) if f.type == pfs.FileType.File]
        seen = [f for f in under if not any(part[:1] in ("_", ".") for part in f.path.removeprefix(path).strip("/").split("/"))]
        return sorted((f for f in seen if PACKAGE_NAME.search(f.path) or page_of(f.path)), key=lambda f: f.path)

    def shares(self, files: list[pfs.FileInfo]) -> list[ds.InputPartition]:
        system, _ = located(self.path)
        packages = [f.path for f in files if PACKAGE_NAME.search(f.path)]
        pages = [(f.path, f.size) for f in files if not PACKAGE_NAME.search(f.path) and self.asked(f.path)]
        out: list[ds.InputPartition] = [] if self.raw else [Files(run) for run in shared(pages, self.share_bytes)]
        for package in packages:
            if self.sha256:
                out.append(Hashed(package, self.sha256))
            with system.open_input_file(package) as f:
                try:
                    with tarfile.open(fileobj=f, mode="r:") as tar:
                        members = [((e.name, e.offset_data, e.size), e.size) for e in allowed(tar) if self.asked(e.name)]
                except tarfile.ReadError:
                    out.append(Packed(package))
                else:
                    out += [Members(package, run) for run in shared(members, self.share_bytes)]
        return out

    def contents(self, share: ds.InputPartition) -> Iterator[tuple[str, bytes]]:
        """(name, bytes as stored) of what a share holds, one at a time."""
        system, _ = located(self.path)
        match share:
            case Files(paths):
                for path in paths:
                    with system.open_input_stream(path, compression=None) as f:
                        yield path, f.read()
            case Members(package, members):
                with system.open_input_file(package) as f:
                    for name, place, size in members:
                        yield name, f.read_at(size, place)
            case Packed(package):
                with system.open_input_stream(package, compression=None) as f, tarfile.open(fileobj=f, mode="r|*") as tar:
                    for entry in allowed(tar):
                        if self.asked(entry.name):
                            yield entry.name, tar.extractfile(entry).read()
            case Hashed(package, announced):
                digest = hashlib.sha256()
                with system.open_input_stream(package, compression=None) as f:
                    while block := f.read(BLOCK):
                        digest.update(block)
                if digest.hexdigest() != announced.lower():
                    raise ValueError("the package's hash is not the one that was announced")

    def read(self, share: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name, content in self.contents(share):
            row = (name.rsplit("/", 1)[-1], content) if self.raw else (*page_of(name), html_of(content, name))
            rows.append(row)
            held += len(row[-1])
            if held > BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)
        rows.clear()
        workers.give_back()

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        schema = ENTRY_SCHEMA if self.raw else PAGE_SCHEMA
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class Pages(Shares, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))[0]
            if not self.raw and type(f) in DECIDED and column in ("issue", "code", "page"):
                self.conditions.append(Condition(column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[ds.InputPartition]:
        return self.shares(self.files())


class NewPages(Shares, ds.DataSourceStreamReader):
    last: int | None = None

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        horizon = time.time_ns() - int(self.settle * 1e9)
        # without news the offset stays, so no empty batches; the first one of a run does not know the last run's
        if self.last is None or any(self.last <= f.mtime_ns < horizon for f in self.files()):
            self.last = max(horizon, self.last or 0)
        return {"until": self.last}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        return self.shares([f for f in self.files() if start["until"] <= f.mtime_ns < end["until"]])


@dataclass
class Packages(ds.WriterCommitMessage):
    names: list[str]


class Packer(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.most = min(int(options.get("package_bytes", 256 << 20)), PACKAGE_MOST)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Packages:
        system, path = located(self.path)
        system.create_dir(folder := f"{path}/{UNFINISHED}/{self.job}", recursive=True)
        names: list[str] = []
        stream = tar = None
        held = 0
        for batch in batches:
            for issue, code, page, html in zip(*(batch.column(n).to_pylist() for n in PAGE_SCHEMA.names)):
                if None in (issue, code, page):
                    raise ValueError("a page without issue, code or number has no name")
                content = gzip.compress((html or "").encode(), mtime=0)
                if len(content) > ENTRY_MOST:
                    raise ValueError(f"{issue}-{code}, page {page}: over the limit of an entry")
                if tar is None or held + len(content) > self.most:
                    if tar:
                        tar.close(), stream.close()
                    names.append(f"{uuid.uuid4().hex}.tar")
                    stream, held = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                    tar = tarfile.open(fileobj=stream, mode="w|")
                info = tarfile.TarInfo(f"pages/{issue}-{code}{f'.p{page}' if page != 1 else ''}.html.gz")
                info.size = len(content)
                tar.addfile(info, io.BytesIO(content))
                held += len(content)
        if tar:
            tar.close(), stream.close()
        workers.give_back()
        return Packages(names)

    def commit(self, messages: list[Packages | None]) -> None:
        system, path = located(self.path)
        system.create_dir(path, recursive=True)
        earlier = [f.path for f in system.get_file_info(pfs.FileSelector(path)) if f.type == pfs.FileType.File and PACKAGE_NAME.search(f.path)]
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{path}/{UNFINISHED}/{self.job}/{name}", f"{path}/{name}")
        for package in earlier if self.overwrite else ():
            system.delete_file(package)
        self.abort(messages)  # what lost attempts of tasks left

    def abort(self, messages: list[Packages | None]) -> None:
        system, path = located(self.path)
        if system.get_file_info(folder := f"{path}/{UNFINISHED}/{self.job}").type == pfs.FileType.Directory:
            system.delete_dir(folder)


class Bulletin(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "bulletin"

    def schema(self) -> str:
        return ENTRIES if self.options.get("raw", "false").lower() == "true" else PAGES

    def reader(self, schema) -> Pages:
        return Pages(self.options)

    def streamReader(self, schema) -> NewPages:
        return NewPages(self.options)

    def writer(self, schema, overwrite: bool) -> Packer:
        return Packer(self.options, overwrite)


def registered(spark: SparkSession) -> SparkSession:
    """The session with the format known to it, and filters handed to sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bulletin)
    return spark


def pages(spark: SparkSession, path: str) -> DataFrame:
    """issue, code, page, html of the pages and packages under `path`."""
    return registered(spark).read.format("bulletin").load(path)


def entries(spark: SparkSession, path: str, sha256: str | None = None) -> DataFrame:
    """name, content of the allowed entries of packages; a package over its limits or with another hash raises."""
    read = registered(spark).read.format("bulletin").option("raw", True)
    return (read.option("sha256", sha256) if sha256 else read).load(path)


def write_packages(frame: DataFrame, path: str, mode: str = "append", package_bytes: int = 256 << 20) -> None:
    """Pages as packages under `path`, in the order that they have in their partitions."""
    spark = registered(frame.sparkSession)
    with workers.held(spark, workers.small_batches(spark)):
        frame.select(*PAGE_SCHEMA.names).write.format("bulletin").option("package_bytes", package_bytes).mode(mode).save(path)
