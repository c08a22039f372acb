"""Content-addressed store of token ids.

Documents are encoded and cut into chunks where a rolling hash over the last `WINDOW` ids has `CUT_BITS` low zero bits,
so equal passages give equal chunks wherever they stand. A chunk is named by the SHA-256 of its ids as little-endian
unsigned 32-bit integers and is stored once. A document is a recipe: the names of its chunks, in order, with a Merkle
root over them; recipes lie in ascending order of doc_id, and each knows how many ids all documents before it have. The
concatenation of the recipes' chunks in that order is the id file.

Layout under `path`: cut/is_chunk=true (digests, n, payload), one row a distinct chunk; recipes/ (doc_id, start, n_tokens, digests,
root, file_part), range-sorted by doc_id; manifest/ (file_part, first_id, n_docs, n_tokens, root), one row a recipe file, whose
roots are Merkle roots over its recipes' roots; head/ (n_files, n_docs, n_tokens, root), one row over the manifest.

Only one shuffle carries ids: chunks are dealt by name, after each task has dropped its own repeats, so a passage that a
third of all documents share arrives once a task. Reading verifies the manifest against its head and every recipe file
against its manifest row (a lost file, a gap or a changed recipe raises), every chunk against its name, joins recipes to
chunk sums (not to ids; a chunk that many documents share is dealt over parts), rebuilds every root, and combines the
chunks' CRC-32 sums over GF(2) into the document's.

Defined results: a null text counts as empty and has the end id alone; null doc_ids come last; documents with equal ids
follow one another in the order of their roots; an empty table gives an empty store and result; other columns are
not read; texts of any length are encoded whole; the string of an added token in a text is that token, as the library has it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import encoder
from .shared import lean_batches, remove, salt, salt_mask, salted, scratch_root, tidy

END_ID = 2
WINDOW, CUT_BITS, LEAST, MOST = 8, 10, 256, 8192
#: Ids hashed at a time.
BLOCK = 1 << 18
#: Names of chunks that a task remembers having passed on; beyond them repeats go to the shuffle, which drops them.
NAMES = 200_000


@cache
def gear() -> np.ndarray:
    """64-bit values of the rolling hash by id, modulo 65536."""
    x = (np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash allows a cut."""
    out = [np.zeros(0, np.int64)]
    for at in range(0, len(ids), BLOCK):
        begin = max(0, at - WINDOW + 1)
        values = gear()[ids[begin : at + BLOCK].astype(np.int64) & 0xFFFF]
        rolled = values.copy()
        for k in range(1, min(WINDOW, len(values))):  # each id is weighed by its distance from the window's end
            rolled[k:] += values[:-k] * np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64))
        out.append(begin + np.flatnonzero((rolled[at - begin :] >> np.uint64(64 - CUT_BITS)) == 0) + at - begin + 1)
    return np.concatenate(out)


def chunk_ends(allowed: list[int], at: int, end: int) -> list[int]:
    """Ends of the chunks of the document from `at` to `end`: allowed places, LEAST to MOST ids apart; the last is its end.

    Documents can lie side by side: a window that reaches into the one before ends less than LEAST ids from the start."""
    out = []
    for m in allowed:
        if m - at < LEAST:
            continue
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST:
            out.append(m)
            at = m
    while end - at > MOST:
        at += MOST
        out.append(at)
    if at < end:
        out.append(end)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    return chunk_ends(marks(ids).tolist(), 0, len(ids))


def merkle(leaves: list[bytes]) -> bytes:
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of two kinds: recipes (doc_id, n, digests of 32 bytes each) and chunks (digest, n, payload), the latter once a task."""
    lean_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    fields = [("is_chunk", pa.bool_()), ("doc_id", None), ("digests", pa.binary()), ("n", pa.int64()), ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pack, seen = encoder(tokenizer), zstandard.ZstdCompressor(3), set()

        def out(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_type) for c, (_, t) in zip(columns, fields)], [k for k, _ in fields])

        for b in batches:
            ready: list[tuple] = []
            held = 0
            ids, ends = with_ends(*enc.encode(b.column(1)), end_id)
            allowed = marks(ids)
            upto = np.searchsorted(allowed, ends, "right")
            at = first = 0
            for doc_id, end, last in zip(b.column(0).to_pylist(), ends.tolist(), upto.tolist()):
                names, begin = [], at
                for stop in chunk_ends(allowed[first:last].tolist(), at, end):
                    part, at = ids[at:stop], stop
                    names.append(hashlib.sha256(part.astype("<u4").tobytes()).digest())
                    if names[-1] not in seen:
                        if len(seen) >= NAMES:
                            seen.clear()
                        seen.add(names[-1])
                        ready.append((True, None, names[-1], len(part), pack.compress(part.tobytes())))
                        held += len(ready[-1][-1])
                ready.append((False, doc_id, b"".join(names), end - begin, None))
                first = last
                if held > 8_000_000:
                    yield out(ready, b.schema.field(0).type)
                    ready, held = [], 0
            if ready:
                yield out(ready, b.schema.field(0).type)

    return rows.mapInArrow(tidy(run), f"is_chunk boolean, doc_id {kind}, digests binary, n long, payload binary")


def with_ends(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts side by side, and where each text's end, with the end id put after each."""
    ends = ends + np.arange(1, len(ends) + 1)
    out = np.full(len(ids) + len(ends), end_id, ids.dtype)
    own = np.ones(len(out), bool)
    own[ends - 1] = False
    out[own] = ids
    return out, ends


def root_of(digests: pd.Series) -> pd.Series:
    return digests.map(lambda d: merkle([d[i : i + 32] for i in range(0, len(d), 32)]))


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> str:
    """Write the store of `docs` under `path`, which must not exist."""
    spark = docs.sparkSession
    cut = cut_documents(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id)
    # one shuffle: a chunk's repeats come together by its name, and recipes are dealt by theirs beside them
    nth = F.row_number().over(W.partitionBy("is_chunk", "digests", "doc_id").orderBy("n"))
    once = cut.withColumn("nth", nth).filter(~F.col("is_chunk") | (F.col("nth") == 1)).drop("nth")
    once.write.option("compression", "zstd").partitionBy("is_chunk").parquet(f"{path}/cut")
    recipes = cut_files(spark, path, False, dict(once.dtypes)["doc_id"]).select("doc_id", F.col("n").alias("n_tokens"), "digests")
    recipes = recipes.withColumn("root", F.pandas_udf(root_of, "binary")("digests"))
    recipes = recipes.orderBy(F.col("doc_id").asc_nulls_last(), "root").withColumn("file_part", F.spark_partition_id())
    recipes.write.option("compression", "zstd").parquet(f"{path}/sorted")
    remove(spark, f"{path}/cut/is_chunk=false")
    return finish(spark, path)


def cut_files(spark: SparkSession, path: str, is_chunk: bool, id_type: str = "long") -> DataFrame:
    """The chunks or the recipes of one pass; an empty store has neither folder."""
    rows = spark.read.schema(f"doc_id {id_type}, digests binary, n long, payload binary, is_chunk string").parquet(f"{path}/cut")
    return rows.filter(F.col("is_chunk") == str(is_chunk).lower())


def finish(spark: SparkSession, path: str) -> str:
    """Starts, recipe files and manifest, from the sorted recipes."""
    rows = spark.read.parquet(f"{path}/sorted")
    in_order = W.partitionBy("file_part").orderBy(F.col("doc_id").asc_nulls_last(), "root").rowsBetween(W.unboundedPreceding, -1)
    # a row a file of recipes: as many as the sort had tasks
    parts = rows.groupBy("file_part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("file_part", F.coalesce(F.sum("n").over(W.orderBy("file_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_order), F.lit(0))).join(parts, "file_part").select(
        "doc_id", (F.col("ahead") + F.col("inside")).cast("long").alias("start"), "n_tokens", "digests", "root", "file_part"
    ).sortWithinPartitions("file_part", "start").write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove(spark, f"{path}/sorted")
    sealed(spark, path).write.parquet(f"{path}/manifest")
    head = head_of(manifest_rows(spark.read.schema(SEAL).parquet(f"{path}/manifest")))
    spark.createDataFrame([head], "n_files long, n_docs long, n_tokens long, root binary").write.parquet(f"{path}/head")
    return path


SEAL = "file_part int, first_id long, n_docs long, n_tokens long, root binary"


def sealed(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, from the recipe files: a row a file. Raises where the starts within a file do not follow one another."""

    def seal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "n_tokens"])
        if (pdf.start.to_numpy()[1:] != pdf.start.to_numpy()[:-1] + pdf.n_tokens.to_numpy()[:-1]).any():
            raise ValueError(f"starts of recipe file {pdf.file_part.iloc[0]} do not follow one another")
        return pd.DataFrame({"file_part": pdf.file_part.iloc[:1], "first_id": pdf.start.iloc[:1], "n_docs": [len(pdf)], "n_tokens": [pdf.n_tokens.sum()], "root": [merkle(list(pdf.root))]})

    recipes = spark.read.schema("start long, n_tokens long, root binary, file_part int").parquet(f"{path}/recipes")
    return recipes.groupBy("file_part").applyInPandas(seal, SEAL)


def manifest_rows(manifest: DataFrame) -> list[tuple]:
    """A row a recipe file: as many as the sort had tasks."""
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in manifest.collect())


def head_of(rows: list[tuple]) -> tuple[int, int, int, bytes]:
    at = 0
    for part, first_id, _, n_tokens, _ in rows:
        if first_id != at:
            raise ValueError(f"recipe file {part} does not start where the one before ends")
        at += n_tokens
    return len(rows), sum(r[2] for r in rows), at, merkle([r[4] for r in rows])


def verify(spark: SparkSession, path: str) -> None:
    """Raises unless the manifest is the one of its head, and the recipe files are those of the manifest."""
    stated = manifest_rows(spark.read.schema(SEAL).parquet(f"{path}/manifest"))
    if manifest_rows(spark.read.parquet(f"{path}/head")) != [head_of(stated)]:
        raise ValueError("the manifest does not match its head")
    if stated != manifest_rows(sealed(spark, path)):
        raise ValueError("the recipe files do not match the manifest")


POLYNOMIAL = 0xEDB88320


def times(a: int, b: int) -> int:
    """Product of two residues of the CRC polynomial, bits reversed."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return out


@cache
def shift(n_bytes: int) -> int:
    """x ** (8 * n_bytes)."""
    out, square = 1 << 31, 1 << 23
    while n_bytes:
        if n_bytes & 1:
            out = times(out, square)
        square = times(square, square)
        n_bytes >>= 1
    return out


def join_crcs(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a concatenation from (crc, bytes) of its parts."""
    out = 0
    for crc, n in parts:
        out = times(shift(n), out) ^ crc
    return out


def chunk_sums(spark: SparkSession, path: str) -> DataFrame:
    """(digest, n, crc) of every stored chunk, its payload checked against its name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            crcs = []
            for name, n, payload in zip(*(c.to_pylist() for c in b.columns)):
                raw = unpack.decompress(payload)
                raw = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4").tobytes()
                if hashlib.sha256(raw).digest() != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its name says")
                crcs.append(zlib.crc32(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    stored = cut_files(spark, path, True).select("digests", "n", "payload")
    return stored.mapInArrow(tidy(run), "digest binary, n long, crc long")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; raises where they do not agree."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for n_tokens, digests, root, names, each, n in zip(*(c.to_pylist() for c in b.columns[2:])):
                if b"".join(names or ()) != digests or sum(n) != n_tokens or merkle(names) != root:
                    raise ValueError("a recipe does not match its chunks")
                crcs.append(join_crcs([(c, 4 * k) for c, k in zip(each, n)]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    verify(spark, path)
    recipes = spark.read.parquet(f"{path}/recipes")
    at = F.sequence(F.lit(0), (F.length("digests") / 32).cast("int") - 1)
    named = recipes.select("start", F.explode(at).alias("at"), "digests").select("start", "at", F.expr("substring(digests, at * 32 + 1, 32)").alias("digest"), salt(F.col("start")).alias("part"))
    asked = named.groupBy("digest").agg(salt_mask(F.col("part")).alias("mask"))
    sums_of = salted(chunk_sums(spark, path).join(asked, "digest"), "mask", "part")
    found = named.join(sums_of, ["digest", "part"]).groupBy("start").agg(F.sort_array(F.collect_list(F.struct("at", "digest", "crc", "n"))).alias("c"))
    whole = recipes.join(found, "start", "left").select("doc_id", "start", "n_tokens", "digests", "root", F.col("c.digest").alias("names"), F.col("c.crc").alias("crc"), F.col("c.n").alias("n"))
    return whole.mapInArrow(tidy(sums), f"doc_id {dict(recipes.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the documents rebuilt in full."""

    @F.pandas_udf("array<long>")
    def joined(chunks: pd.Series) -> pd.Series:
        unpack = zstandard.ZstdDecompressor()
        out = []
        for parts in chunks:
            parts = sorted((p if isinstance(p, dict) else p.asDict() for p in parts), key=lambda p: p["at"])
            raws = [(unpack.decompress(p["payload"]), p["n"]) for p in parts]
            out.append(np.concatenate([np.frombuffer(r, f"<u{len(r) // n}").astype(np.int64) for r, n in raws]))
        return pd.Series(out)

    recipes = spark.read.parquet(f"{path}/recipes")
    at = F.sequence(F.lit(0), (F.length("digests") / 32).cast("int") - 1)
    named = recipes.select("doc_id", "start", F.explode(at).alias("at"), "digests").select("doc_id", "start", "at", F.expr("substring(digests, at * 32 + 1, 32)").alias("digest"))
    stored = cut_files(spark, path, True).select(F.col("digests").alias("digest"), "n", "payload")
    parts = named.join(stored, "digest").groupBy("doc_id", "start").agg(F.collect_list(F.struct("at", "n", "payload")).alias("chunks"))
    return parts.select("doc_id", "start", joined("chunks").alias("ids"))


def store_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write a store of `docs` in the shared folder and return what reading it back gives."""
    spark = docs.sparkSession
    path = f"{scratch_root(spark)}/florilege/{uuid.uuid4().hex}-ids"
    return read_documents(spark, write_store(docs, path, tokenizer))
