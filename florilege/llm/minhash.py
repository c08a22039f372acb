"""MinHash near-duplicates: documents whose sets of 5-word shingles have a Jaccard similarity of 0.85 or more.

One-permutation hashing: a shingle has one hash; the hashes are dealt by their size over `BANDS * ROWS` bins, and the smallest of a bin is its
value. An empty bin takes the value of the first bin that is not empty in an order of its own, the same for all documents
(optimal densification), so two documents agree in a bin with the probability of their similarity. `ROWS` bins make a band; documents that agree in a
band meet in a bucket. A pair at the threshold meets in no bucket with probability (1 - 0.85 ** 6) ** 36 = 4e-8, more similar ones with less.

Equal sets are folded first, so copies of any number are one node. Candidates within a bucket form a star, not all pairs: each member is paired
with the bucket's centre, the member that meets the most others over all its buckets (in a group of edited copies that is
the text they were edited from). Links are confirmed on the full sets. What a star cannot settle is settled exactly: in buckets
whose members are still in several components, members outside the largest are compared with all members of other components, in blocks of `BLOCK`
by `BLOCK`, dealt over tasks; a pair comes out of this only if its sizes and the parities of its hashes over 512 bits allow the similarity, which
loses no link. So components are those of all pairs that meet in a bucket.

Confirming reads the texts again, and of them only those in candidate pairs. Shingles stand for 64 bits of a hash made of their words' hashes.

Defined results: null and empty texts and those without words have an empty set, size 0, and are linked with nothing; fewer than five words make one
shingle; ids keep their type, whatever orders; null doc_ids take part with a null id and never name a component unless the whole component has
none; repeated rows are returned as they are (kept where their id is the component's; null ids where the component has none); an empty
table gives an empty result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import forget, lean_batches, materialize, salt, salt_mask, salted, tidy

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 36, 6
#: Longs of the parity sketch; members of a block.
SKETCH, BLOCK = 8, 256
ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
WORDS = [f"w{i}" for i in range(SKETCH)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[14]
    h = (h ^ (h >> np.uint64(29))) * ODD[15]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    # fewer words than k: the whole sequence, told apart by the factors' places from any longer one
    parts = [h[i : i + n] * ODD[i] for i in range(min(k, len(words)))]
    return np.unique(mixed(np.sum(parts, axis=0, dtype=np.uint64) + np.uint64(len(parts))))


@cache
def bin_edges(bins: int) -> np.ndarray:
    return np.array([(i << 64) // bins for i in range(bins)], np.uint64)


@cache
def other_bins(bins: int) -> np.ndarray:
    """By bin, all bins in the order in which it borrows from them."""
    return np.random.default_rng(13).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)


def bin_values(hashes: np.ndarray, bins: int) -> np.ndarray:
    """The smallest hash of each bin; an empty bin borrows. `hashes` are sorted and not none."""
    edges = bin_edges(bins)
    first = np.searchsorted(hashes, edges)
    after = np.append(first[1:], len(hashes))
    filled = first < after
    values = hashes[np.minimum(first, len(hashes) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        order = other_bins(bins)[empty]
        values[empty] = values[order[np.arange(len(empty)), filled[order].argmax(1)]]
    return values


def band_keys(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    values = mixed(bin_values(hashes, bands * rows).reshape(bands, rows) * ODD[:rows]).sum(1, dtype=np.uint64)
    return mixed(values + np.arange(bands, dtype=np.uint64) * ODD[13]).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Over 64 * SKETCH bits, whether an odd number of hashes falls on each: two sketches differ in as many bits as the sets do at most."""
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_linked(percent: int) -> int:
    """A set of fewer shingles is similar enough only to its equal: one shingle more in the union is too many."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def prints(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """(id, text_key, digest, n, w0..w7, bands); bands empty where only equal sets are similar."""
    lean_batches(docs.sparkSession)
    least = least_linked(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, sketches, bands = [], [], [], []
            for text in b.column(2):
                hashes = shingle_set(text.as_py(), k)
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                sketches.append(parities(hashes))
                bands.append(band_keys(hashes) if len(hashes) >= least else ())
            sketch = np.array(sketches, np.int64).reshape(-1, SKETCH)
            columns = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *map(pa.array, sketch.T), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["id", "text_key", "digest", "n", *WORDS, "bands"])

    rows = keyed(docs, text_col, F.col(id_col).alias("id"))
    return rows.mapInArrow(tidy(run), f"id {dict(rows.dtypes)['id']}, text_key binary, digest binary, n long, {', '.join(f'{w} long' for w in WORDS)}, bands array<long>")


def keyed(docs: DataFrame, text_col: str, *columns: Column) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(*columns, F.unhex(F.md5(text.cast("binary"))).alias("text_key"), text.alias("text"))


def may_be_linked(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches allow the similarity: with D the size of the symmetric difference and S the sum of sizes,
    it is reached where 100 (S - D) >= percent (S + D), and the sketches differ in D bits at most."""
    s = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in WORDS), F.lit(0))
    sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
    return sizes & ((100 + percent) * apart <= (100 - percent) * s)


def buckets_of(nodes: DataFrame) -> DataFrame:
    """(bucket, node, met, part) of buckets with two nodes or more; `met`: members of all the node's buckets, counted in each."""
    rows = nodes.select("node", F.explode("bands").alias("bucket")).withColumn("part", salt(F.col("node")))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("size"), salt_mask(F.col("part")).alias("mask")).filter("size > 1")
    met = rows.join(salted(counts, "mask", "part"), ["bucket", "part"])
    # a node has BANDS buckets at most
    met = met.groupBy("node").agg(F.sum("size").alias("met"), F.collect_list("bucket").alias("buckets"))
    return met.select("node", "met", F.explode("buckets").alias("bucket")).withColumn("part", salt(F.col("node")))


def stars(members: DataFrame) -> DataFrame:
    """(a, b): each member and its bucket's centre."""
    centre = F.max(F.struct("met", "node")).getField("node").alias("centre")
    centres = members.groupBy("bucket").agg(centre, salt_mask(F.col("part")).alias("mask"))
    pairs = members.join(salted(centres, "mask", "part"), ["bucket", "part"]).filter("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def unsettled(members: DataFrame, found: DataFrame, nodes: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of a bucket in different components that may be linked."""
    labelled = members.join(found, "node", "left").select("bucket", "node", "part", F.coalesce("component", "node").alias("label"))
    labelled = materialize(labelled, "labels", narrow=True)
    by_label = labelled.groupBy("bucket", "label").agg(F.count("*").alias("c"))
    several = by_label.groupBy("bucket").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("largest"), F.count("*").alias("labels")).filter("labels > 1")
    parts = labelled.groupBy("bucket").agg(salt_mask(F.col("part")).alias("mask"))
    several = several.join(parts, "bucket").select("bucket", "size", F.col("largest.label").alias("most"), (F.col("size") - F.col("largest.c")).alias("others"), "mask")
    rows = labelled.join(salted(several, "mask", "part"), ["bucket", "part"]).drop("part")
    rows = materialize(rows.join(nodes.select("node", "n", *WORDS), "node"), "mixed")
    blocks = lambda count: F.ceil(F.col(count) / block).cast("int")
    own = lambda count: F.pmod(F.xxhash64("node"), blocks(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), blocks(count) - 1))
    others = rows.filter("label <> most").select("*", own("others").alias("x")).select("*", every("size").alias("y"))
    whole = rows.select("*", own("size").alias("y")).select("*", every("others").alias("x"))
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y"))
    once = (F.col("b.label") == F.col("b.most")) | (F.col("a.node") < F.col("b.node"))
    pairs = others.alias("a").join(whole.alias("b"), on & (F.col("a.label") != F.col("b.label")) & once & may_be_linked("a", "b", percent))
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, k: int, percent: int) -> DataFrame:
    """Of (a, b), those that are similar enough on their full sets."""
    known = nodes.select("node", "n", "text_key", *WORDS)
    met = materialize(pairs, "pairs")
    both = met.join(known.alias("l"), F.col("a") == F.col("l.node")).join(known.alias("r"), F.col("b") == F.col("r.node")).filter(may_be_linked("l", "r", percent))
    both = materialize(both.select("a", "b", F.col("l.text_key").alias("key_a"), F.col("r.text_key").alias("key_b")), "possible")
    needed = both.select(F.explode(F.array("key_a", "key_b")).alias("text_key")).distinct()
    texts = keyed(docs, text_col).join(materialize(needed, "needed"), "text_key", "left_semi")
    texts = materialize(texts.groupBy("text_key").agg(F.first("text").alias("text")), "texts")
    rows = both.join(texts.select(F.col("text_key").alias("key_a"), F.col("text").alias("text_a")), "key_a")
    rows = rows.join(texts.select(F.col("text_key").alias("key_b"), F.col("text").alias("text_b")), "key_b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(64)(lambda text: shingle_set(text, k))  # a centre stands in many pairs
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = (sets(t) if len(t) < 1 << 16 else shingle_set(t, k) for t in (left.as_py(), right.as_py()))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept)], ["a", "b"])

    links = materialize(rows.mapInArrow(tidy(run), "a long, b long"), "links", narrow=True)
    forget(both, texts)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id)."""
    rows = prints(docs, id_col, text_col, k, percent).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("part", salt(F.col("row"))).drop("row"), "prints", narrow=True)
    one = [F.first(c).alias(c) for c in ("n", "text_key", *WORDS, "bands")]
    nodes = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("least"), salt_mask(F.col("part")).alias("mask"), *one)
    nodes = materialize(nodes, "sets").withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")  # the numbers are read many times
    members = materialize(buckets_of(nodes), "members")
    near = confirmed(stars(members), nodes, docs, text_col, k, percent)
    found = materialize(components(near), "components")
    rest = confirmed(unsettled(members, found, nodes, percent, block), nodes, docs, text_col, k, percent)
    forget(members)
    if not rest.isEmpty():
        found = materialize(components(near.union(rest)), "components")
    # the smallest id of a component of any size, for each part of its nodes
    linked = nodes.join(found, "node").select("node", "digest", "mask", "least", "component").withColumn("deal", salt(F.col("node")))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), salt_mask(F.col("deal")).alias("deals"))
    linked = linked.join(salted(least, "deals", "deal"), ["component", "deal"]).select("digest", "mask", "component_id")
    alone = nodes.join(found, "node", "left_anti").select("digest", "mask", F.col("least").alias("component_id"))
    named = rows.filter("n > 0").join(salted(linked.union(alone), "mask", "part"), ["digest", "part"]).select("id", "n", "component_id")
    every = named.union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
