"""Importance resampling towards a target distribution, over hashed n-grams whose CRC-32 is composed, not computed from strings.

CRC-32 is linear over GF(2): the CRC of A followed by B is the CRC of A, multiplied by the matrix that appends as many zero
bytes as B has, plus the CRC of B. A word's CRC is computed once from its bytes. The CRC of `w1 w2 ... wn` is then composed
word by word with these matrices; no n-gram string is ever made. The matrix for a length is the product of those for the powers of two in it,
each kept as four tables of 256 numbers, so words of any length cost at most 32 steps for a whole block of words.

Three passes. The first counts features by bucket, of the documents and of the target texts: a task sums what it has read
and hands on one row a bucket. The gains of the buckets, `buckets` numbers, are what the driver sees. The second
weighs every document and writes the scores. The third deals the documents that may be drawn into ranges of (score, doc_id); a rank is
the number of rows in the ranges before plus the place within the range, so no task ranks more than its own range.

Defined results: a null or empty text has no features and weight 0; null and repeated doc_ids give a row each, a null doc_id
draws like the empty string and comes last among ties; rows that tie in all share consecutive ranks; an empty target leaves all gains to the documents' own counts; an empty table gives an
empty result; texts of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import lean_batches, materialize, tidy

BUCKETS, NGRAMS, LEAST_WORDS, SHARE, SEED = 10_000, (1, 1), 20, 10, "2024"
#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words whose n-grams are composed at a time, which bounds the memory for a text of any length.
BLOCK = 1 << 18
NOT_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(NOT_WORD).split()


def times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`matrix`, as four tables for the bytes of a number, times each of `x`."""
    return matrix[0][x & 255] ^ matrix[1][(x >> 8) & 255] ^ matrix[2][(x >> 16) & 255] ^ matrix[3][x >> 24]


@cache
def zero_bytes(power: int) -> np.ndarray:
    """The matrix that appends 2 ** power zero bytes."""
    if power:
        half = zero_bytes(power - 1)
        return np.array([times(half, part) for part in half])
    values = np.arange(256, dtype=np.uint32)
    by_byte = values.copy()
    for _ in range(8):
        by_byte = np.where(by_byte & 1, (by_byte >> 1) ^ np.uint32(POLYNOMIAL), by_byte >> 1)
    return np.array([by_byte, *(values << np.uint32(8 * (k - 1)) for k in (1, 2, 3))], np.uint32)


def lengthened(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved past as many bytes as its length says."""
    out = crcs.copy()
    for power in range(int(lengths.max(initial=0)).bit_length()):
        has = (lengths >> power) & 1 == 1
        out[has] = times(zero_bytes(power), out[has])
    return out


def composed(crcs: np.ndarray, lengths: np.ndarray, n: int, before: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """CRCs of all runs of n words, from `before`, those of the runs of n - 1 words; `tails` are those of a blank and a word."""
    if n == 1:
        return crcs
    return lengthened(before[: len(crcs) - n + 1], lengths[n - 1 :] + 1) ^ tails[n - 1 :]


def feature_crcs(words: list[bytes], ngrams: tuple[int, int] = NGRAMS) -> Iterator[np.ndarray]:
    """CRCs of all runs of ngrams[0] to ngrams[1] words joined by one blank, repeats included, a few at a time."""
    least, most = ngrams
    for at in range(0, len(words), BLOCK):
        own = min(BLOCK, len(words) - at)
        part = words[at : at + own + most - 1]
        crcs = np.fromiter(map(crc32, part), np.uint32, len(part))
        lengths = tails = crcs
        if most > 1:
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            tails = lengthened(np.full(len(part), crc32(b" "), np.uint32), lengths) ^ crcs
        runs = crcs
        for n in range(1, min(most, len(part)) + 1):
            runs = composed(crcs, lengths, n, runs, tails)
            if n >= least:
                yield runs[:own]


def bucket_counts(texts: DataFrame, text_col: str, name: str, buckets: int, ngrams: tuple[int, int]) -> DataFrame:
    """(bucket, `name`): features of the texts by bucket; a row a bucket and task, summed over tasks."""
    lean_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column(0):
                for crcs in feature_crcs(words_of(text.as_py()), ngrams):
                    counts += np.bincount(crcs % buckets, minlength=buckets)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "bucket long, n long")
    return rows.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS, text_col: str = "text") -> list[int]:
    """By bucket: 1000 times the log of how much likelier the target has it than the documents, both smoothed, rounded down."""
    counts = bucket_counts(docs, text_col, "s", buckets, ngrams).join(bucket_counts(target, text_col, "t", buckets, ngrams), "bucket", "full")
    s, t = [0.0] * buckets, [0.0] * buckets
    for r in counts.collect():  # a row a bucket
        s[r["bucket"]], t[r["bucket"]] = float(r["s"] or 0), float(r["t"] or 0)
    all_s, all_t = sum(s) + buckets, sum(t) + buckets
    return [math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t)]


def weighed(docs: DataFrame, gain: list[int], ngrams: tuple[int, int] = NGRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    lean_batches(docs.sparkSession)
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1):
                words = words_of(text.as_py())
                parts = [(len(c), int(table[c % len(table)].sum())) for c in feature_crcs(words, ngrams)]
                out.append((len(words), sum(n for n, _ in parts), sum(w for _, w in parts)))
            columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """`rows` with rank, from 1, by score downwards, then doc_id, null last. Every range of rows is sorted by itself."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange(parts, *order) if parts else numbered.repartitionByRange(*order)
    # the number of a row holds its partition, which are ranges in order, above its place there
    placed = materialize(dealt.sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("row"), "ranges", narrow=False)
    placed = placed.select("*", F.shiftright("at", 33).alias("range"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"))
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    # a row a range, of which there are as many as shuffle partitions
    return placed.join(F.broadcast(ranges), "range").withColumn("rank", F.col("ahead") + F.col("place") + 1).drop("range", "place", "at", "ahead")


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, ngrams: tuple[int, int] = NGRAMS, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank: of the documents of `least_words` words, `share` percent are drawn without
    replacement (weights with Gumbel noise from the doc_id); rank is null for the others."""
    gain = gains(docs, target, buckets, ngrams, text_col)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed(docs, gain, ngrams, id_col, text_col).withColumn("score", F.col("weight") + noise), "scores", narrow=True)
    able = scored.filter(F.col("n_words") >= least_words)
    most = able.count() * share // 100
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank"))
    return ranked(able).select(*columns, rank.alias("rank")).union(rest)


def oracle(share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> str:
    """SQL for the rows of `resample` over single words: CRC-32 bit by bit over each distinct word."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    steps = "flatten(list_transform(range(octet_length(encode(w))), lambda i: [('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = f"lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}::BIGINT) ELSE c >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {step}), 4294967295::BIGINT)"
    return (
        f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents), "
        "dw AS (SELECT r, w, count(*) AS c FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL), "
        f"bw AS (SELECT w, count(*) AS c FROM (SELECT unnest({words}) AS w FROM benchmark) GROUP BY ALL), "
        f"crcs AS (SELECT w, {crc} % {buckets} AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw)), "
        "s AS (SELECT b, sum(c)::DOUBLE AS s FROM dw JOIN crcs USING (w) GROUP BY b), t AS (SELECT b, sum(c)::DOUBLE AS t FROM bw JOIN crcs USING (w) GROUP BY b), "
        "n AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS sn, (SELECT coalesce(sum(t), 0) FROM t) AS tn), "
        f"g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (sn + {buckets}) / ((s + 1) * (tn + {buckets}))))::BIGINT AS g FROM s LEFT JOIN t USING (b), n), "
        "w AS (SELECT r, sum(c)::BIGINT AS n_features, sum(c * g)::BIGINT AS weight FROM dw JOIN crcs USING (w) JOIN g USING (b) GROUP BY r), "
        f"h AS (SELECT r, doc_id, ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d), "
        "x AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, "
        "coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h LEFT JOIN w USING (r)), "
        f"k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k FROM x WHERE n_features >= {least_words}), "
        f"m AS (SELECT count(*) * {share} // 100 AS m FROM k) "
        "SELECT doc_id, n_features, weight, score, CASE WHEN k <= m THEN k END AS rank FROM x LEFT JOIN k USING (r), m"
    )
