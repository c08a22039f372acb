"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked at 3 or fewer differing bits.

Candidates come from the pigeonring principle. A fingerprint is a ring of M = 8 segments of 8 bits. If two differ in
at most T = 3 bits, then from some start i every chain of l consecutive segments differs in at most l * T / M bits:
none over 1 or 2 segments, at most one over 3, 4 or 5, at most two over 6 or 7. So the segments i, i+1 are equal and two
of i+2, i+3, i+4 are: 8 starts x 3 choices = 24 keys of 32 bits per distinct fingerprint. Rows that meet under a key
must pass every chain budget from i before the full Hamming check.

Equal fingerprints are folded first, so copies of any number are one node, named by the fingerprint itself. How many share a
key is counted with map-side sums and looked up with the key dealt over parts, so no task holds a key's fingerprints. A key
that more than `MAX_BUCKET` distinct fingerprints share is not expanded into pairs: its fingerprints are linked through hubs,
which is exact. Two values
within 3 bits have a value c within 1 bit of one and 2 bits of the other; under each c all values within 2 bits link to
one that is within 1. That is 2,081 rows for a fingerprint in such a key, however many share it.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other; fewer than three words
make one shingle; ids keep their type, whatever orders; null doc_ids take part with a null id and never name a component unless the whole component has none;
repeated rows are returned as they are; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import lean_batches, materialize, salt, salt_mask, salted, tidy

M, T, BITS = 8, 3, 8
MAX_BUCKET = 512
SHINGLE, SEED = 3, 42
#: Shingles hashed at a time, which bounds the memory for a text of any length.
BLOCK = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < k:
        words, k = [b" ".join(words)], 1
    n, ones = len(words) - k + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + k - 1]
        shingles = part if k == 1 else map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False))
        h = np.array([digest(s, SEED) for s in shingles], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    lean_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"id {dict(rows.dtypes)['id']}, fp long")


def segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, BITS * (M - 1 - i % M)).bitwiseAND(F.lit((1 << BITS) - 1))


def keys(nodes: DataFrame) -> DataFrame:
    """24 rows (node, fp, key, part) per fingerprint; the key holds its start and choice above its 32 bits."""
    fp, all_keys = F.col("fp"), []
    for i in range(M):
        for k, (a, b) in enumerate(((2, 3), (2, 4), (3, 4))):
            key = F.lit(i * 3 + k).cast("long")
            for part in (i, i + 1, i + a, i + b):
                key = F.shiftleft(key, BITS).bitwiseOR(segment(fp, part))
            all_keys.append(key)
    return nodes.select("node", "fp", F.explode(F.array(*all_keys)).alias("key"), salt(F.col("fp")).alias("part"))


def within_budgets(x: Column, start: Column) -> Column:
    """Every chain of l segments from `start` has at most l * T // M set bits in `x`, the exclusive or."""
    turned = F.when(start == 0, x).otherwise(F.call_function("shiftleft", x, start * BITS).bitwiseOR(F.call_function("shiftrightunsigned", x, 64 - start * BITS)))
    ok = F.lit(True)
    for n in range(1, M):
        ok &= F.bit_count(F.shiftrightunsigned(turned, BITS * (M - n))) <= n * T // M
    return ok


def paired(buckets: DataFrame) -> DataFrame:
    x, start = F.col("a.fp").bitwiseXOR(F.col("b.fp")), F.floor(F.shiftright(F.col("a.key"), 4 * BITS) / 3).cast("int")
    met = buckets.alias("a").join(buckets.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")))
    return met.filter(within_budgets(x, start) & (F.bit_count(x) <= T)).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))


def hubbed(crowd: DataFrame) -> DataFrame:
    """Links among `crowd` (node, fp), distinct, that connect what 3 or fewer bits connect."""
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    masks = [0, *bits, *(p | q for i, p in enumerate(bits) for q in bits[:i])]
    at = crowd.select("node", F.explode(F.transform(F.lit(masks), lambda m: F.struct(F.col("fp").bitwiseXOR(m).alias("hub"), (F.bit_count(m) <= 1).alias("near")))).alias("h"))
    at = at.select("node", "h.*")
    heads = at.filter("near").groupBy("hub").agg(F.min("node").alias("a"))
    return at.join(heads, "hub").filter("a <> node").select("a", F.col("node").alias("b"))


def links(nodes: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """`nodes` (node, fp) of distinct fingerprints -> links (a, b) that connect all within T bits."""
    all_keys = keys(nodes)
    counts = all_keys.groupBy("key").agg(F.count("*").alias("n"), salt_mask(F.col("part")).alias("mask")).filter("n > 1")
    buckets = materialize(all_keys.join(salted(counts, "mask", "part"), ["key", "part"]).drop("part"), "buckets")
    out = paired(buckets.filter(F.col("n") <= max_bucket))
    crowd = buckets.filter(F.col("n") > max_bucket).select("node", "fp").distinct()
    if not crowd.isEmpty():
        out = out.union(hubbed(materialize(crowd, "crowd")))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links."""
    prints = fingerprints(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    prints = materialize(prints.withColumn("part", salt(F.col("row"))).drop("row"), "prints", narrow=True)
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least"), salt_mask(F.col("part")).alias("mask")), "nodes")
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), max_bucket)).withColumnRenamed("node", "fp")
    # the smallest id of a component of any size, for each part of its fingerprints
    linked = nodes.join(found, "fp").withColumn("deal", salt(F.col("fp")))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), salt_mask(F.col("deal")).alias("deals"))
    linked = linked.join(salted(least, "deals", "deal"), ["component", "deal"]).select("fp", "mask", "component_id")
    alone = nodes.join(found, "fp", "left_anti").select("fp", "mask", F.col("least").alias("component_id"))
    return prints.join(salted(linked.union(alone), "mask", "part"), ["fp", "part"]).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
