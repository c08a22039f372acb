"""The text index as tables of postings, in segments that are never changed.

A segment holds, under its own folder,

- `padded`: a row a document with its own columns, `doc` (its number in the segment), `n_tokens` and, if the segment was made of texts, its pads;
- `postings`: a row a term, document and field, with the term's places in order, and whether it is the term's first in the document;
- `heads`: a row a term, field and block of `BLOCK` document numbers, with what bounds a score there: how often the term stands in one
  document at most, and the fewest tokens of a document;
- `shelves`: by shelf its first and last term.

Postings are range-partitioned by term and block, their one shuffle, and written a folder a shelf, sorted, in Parquet's delta encodings: a term's
rows lie together, terms share their beginnings, places are stored as steps. Of each block the first row has its head, so heads are a
filter. A shelf is sorted by one task, so there are as many shelves as keep it to `SHELF_TOKENS`. A word, or all words of a prefix, is a
range of terms, so it is found on a few shelves, and no other file is opened. A frequent term spans shelves of its own.

The index itself is a small table of generations: the segments that count and, by segment, the documents in it that are gone. Adding writes a
segment and marks what it replaces, deleting marks, merging writes the live rows of several small segments as one: their postings as
they are, with numbers moved up by whole blocks, so no text is read for its words again. Sizes, document
frequencies and lengths are sums over live rows, so they are those of an index built anew. One writer at a time; readers keep the
generation they opened."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from florilege.operators import index as pads
from florilege.operators import search
from florilege.operators.search import K1, LEAST_IDF, B, Scoring
from florilege.plans.query import Parsed, Phrase, Unit

#: Document numbers in a block, shelves of a segment at least, blocks that are scored before the others are judged.
BLOCK, SHELVES, WAVE = 128, 32, 16
#: Tokens to a shelf, about, and bytes of pads that a task turns into postings: what a task sorts does not grow with the input.
SHELF_TOKENS, LOT = 1_000_000, 32 << 20
#: Segments of one size (within a factor of `TIER`) that may stand side by side, and documents gone from one, at most, whose numbers a merge sends to every task.
TIER, SENT = 4, 1_000_000
ENCODED = {"compression": "zstd", "parquet.writer.version": "v2"}
#: The largest code point: what starts with p lies between p and p followed by it.
LAST = "\U0010ffff"


@dataclass(frozen=True)
class Segment:
    number: int
    path: str
    n_docs: int
    n_tokens: int
    gone: tuple[str, ...] = ()


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    root: str
    fields: tuple[str, ...]
    id_col: str
    generation: int
    segments: tuple[Segment, ...]

    def docs(self) -> DataFrame:
        """Live documents with `segment` and `doc`."""
        return union([alive(self.spark, s, read(self.spark, s, "padded").drop(*(f"pad_{f}" for f in self.fields))) for s in self.segments])

    def rows(self, kind: str, words: Iterable[tuple[str, bool]]) -> DataFrame:
        """`postings` of live documents, or `heads`, of the words (word, whether it is a prefix)."""
        words = list(dict.fromkeys(words))
        parts = []
        for s in self.segments:
            rows = read(self.spark, s, kind).filter(F.col("shelf").isin(shelves_of(self.spark, s, words)) & search.any_of([is_word(F.col("term"), *w) for w in words]))
            parts.append(alive(self.spark, s, rows) if kind == "postings" else rows)
        return union(parts)

    def figures(self) -> tuple[int, float]:
        """Live documents, and their mean size."""
        if not any(s.gone for s in self.segments):
            n, tokens = sum(s.n_docs for s in self.segments), sum(s.n_tokens for s in self.segments)
        else:
            n, tokens = self.docs().agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        return n, (tokens / n if n else 0.0) or 1.0


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Columns of the tables that are alike in all segments.
SCHEMAS = {
    "postings": "doc long, n_tokens long, field int, term string, places array<int>, first boolean, block long, n long, most int, least long, shelf int",
    "heads": "term string, field int, block long, n long, most int, least long, shelf int",
}
#: Tables as they were first opened, by session and path, so that a segment's files, which never change, are listed once.
_tables: dict[tuple[str, str], DataFrame] = {}


def read(spark: SparkSession, s: Segment, kind: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, f"{s.path}/{kind}")
    if key not in _tables:
        _tables[key] = (spark.read.schema(SCHEMAS[kind]) if kind in SCHEMAS else spark.read).parquet(key[1])
    return _tables[key].withColumn("segment", F.lit(s.number))


def alive(spark: SparkSession, s: Segment, rows: DataFrame) -> DataFrame:
    return rows.join(spark.read.parquet(*s.gone).distinct(), "doc", "left_anti") if s.gone else rows


def is_word(term: Column, word: str, prefix: bool) -> Column:
    return (term >= word) & (term < word + LAST) if prefix else term == word


#: Rows of the shelves' tables by path: they are never changed. A row a shelf.
_shelves: dict[str, list[tuple[int, str, str]]] = {}


def shelves_of(spark: SparkSession, s: Segment, words: list[tuple[str, bool]]) -> list[int]:
    """The shelves on which the words can stand."""
    if s.path not in _shelves:
        _shelves[s.path] = [(r["shelf"], r["first"], r["last"]) for r in spark.read.parquet(f"{s.path}/shelves").collect()]
    out = {n for n, first, last in _shelves[s.path] for w, prefix in words if first <= (w + LAST if prefix else w) and w <= last}
    return sorted(out) or [-1]


# ---- writing ------------------------------------------------------------------------------------------------------------


TERM_ROW = "doc long, n_tokens long, field int, term string, places array<int>, first boolean"


def term_rows(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc, n_tokens, field, term, places, first) of padded documents: a lot's tokens are sorted by document and term, and where either changes a posting begins.

    A lot's postings are handed on in the order of a shelf, so that a shelf's task merges runs."""
    pads_of = [f"pad_{f}" for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row, field, place = [], [], [], []
            for k, name in enumerate(pads_of):
                split = pc.split_pattern(pc.utf8_trim(b.column(name), " "), "  ")
                sizes, flat = pc.list_value_length(split).to_numpy(zero_copy_only=False), split.flatten()
                rows_of = np.repeat(np.arange(len(sizes)), sizes)
                there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a pad without words is split into one empty word
                words.append(flat.filter(pa.array(there)))
                row.append(rows_of[there])
                place.append((np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[there])
                field.append(np.full(there.sum(), k))
            coded = pa.concat_arrays(words).dictionary_encode()
            code, row, field, place = coded.indices.to_numpy(), *map(np.concatenate, (row, field, place))
            key = row * max(len(coded.dictionary), 1) + code
            order = np.argsort(key, kind="stable")  # of equal keys the fields and places stay in order
            key, field = key[order], field[order]
            other = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
            starts = np.flatnonzero(other | np.concatenate([[True], field[1:] != field[:-1]])[: len(key)])
            at, places = order[starts], pa.array(place[order], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), places)
            rank = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())[code[at]]
            turn = np.lexsort((row[at], field[starts], rank))
            at, starts = at[turn], starts[turn]
            doc = pa.array(row[at])
            columns = [b.column("doc").take(doc), b.column("n_tokens").take(doc), pa.array(field[starts], pa.int32()), coded.dictionary.take(pa.array(code[at])), lists.take(pa.array(turn)), pa.array(other[starts])]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n_tokens", "field", "term", "places", "first"])

    return docs.filter("n_tokens > 0").select("doc", "n_tokens", *pads_of).mapInArrow(run, TERM_ROW)


#: Settings while postings are written: tasks read `LOT` each, and hand texts on a few at a time; a task writes one shelf, so rows need no order by shelf.
LEAN = {
    "spark.sql.files.maxPartitionBytes": str(LOT),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.maxConcurrentOutputFileWriters": "2",
}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    before = {name: spark.conf.get(name) for name in LEAN}
    try:
        for name, value in LEAN.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def with_heads(rows: DataFrame) -> DataFrame:
    """`rows` with n, most and least of a term, field and block in the first of its rows, null in the others: no shuffle, as a block lies on one shelf."""
    block = W.partitionBy("term", "field", "block").orderBy("doc")
    whole = block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    figures = {"n": F.count("*"), "most": F.max(F.size("places")), "least": F.min("n_tokens")}
    told = rows.withColumns({"leads": F.row_number().over(block) == 1} | {c: f.over(whole) for c, f in figures.items()})  # one pass for all
    return told.withColumns({c: F.when(F.col("leads"), F.col(c)) for c in figures}).drop("leads")


def write_segment(spark: SparkSession, root: str, number: int, docs: DataFrame, fields: tuple[str, ...], shelves: int, block: int) -> Segment:
    path = f"{root}/segments/{number}-{uuid.uuid4().hex}"
    built = pads.build_index(docs, fields).withColumn("doc", F.monotonically_increasing_id())
    built.write.options(**ENCODED).option("parquet.block.size", LOT // 2).parquet(f"{path}/padded")  # numbers are read from here on, not made again
    return shelved(spark, path, number, term_rows(spark.read.parquet(f"{path}/padded"), fields), shelves, block)


def shelved(spark: SparkSession, path: str, number: int, rows: DataFrame, shelves: int, block: int) -> Segment:
    """The segment at `path`, of whose documents (`padded`) `rows` are the postings (TERM_ROW)."""
    n, tokens = spark.read.parquet(f"{path}/padded").agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    rows = rows.withColumn("block", F.floor(F.col("doc") / block))
    dealt = rows.repartitionByRange(max(shelves, -(-tokens // SHELF_TOKENS)), "term", "block").sortWithinPartitions("term", "field", "block", "doc")
    dealt = with_heads(dealt).withColumn("shelf", F.spark_partition_id())
    with lean(spark):
        dealt.write.options(**ENCODED).partitionBy("shelf").parquet(f"{path}/postings")
    heads = spark.read.schema(SCHEMAS["postings"]).parquet(f"{path}/postings").filter("n IS NOT NULL").select("term", "field", "block", "n", "most", "least", "shelf")
    heads.sortWithinPartitions("shelf", "term", "field", "block").write.options(**ENCODED).partitionBy("shelf").parquet(f"{path}/heads")
    spark.read.schema(SCHEMAS["heads"]).parquet(f"{path}/heads").groupBy("shelf").agg(F.min("term").alias("first"), F.max("term").alias("last")).coalesce(1).write.parquet(f"{path}/shelves")
    return Segment(number, path, n, tokens)


def committed(index: Index) -> Index:
    """The index with its segments as the newest generation: the last thing that a change writes."""
    rows = [(s.number, s.path, s.n_docs, s.n_tokens, list(s.gone), list(index.fields), index.id_col, index.generation) for s in index.segments]
    schema = "number int, path string, n_docs long, n_tokens long, gone array<string>, fields array<string>, id_col string, generation int"
    index.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").partitionBy("generation").parquet(f"{index.root}/generations")
    return index


def opened(spark: SparkSession, root: str) -> Index:
    """The newest generation."""
    all_ = spark.read.parquet(f"{root}/generations")
    rows = all_.filter(F.col("generation") == all_.agg(F.max("generation")).first()[0]).orderBy("number").collect()  # a row a segment
    return Index(spark, root, tuple(rows[0]["fields"]), rows[0]["id_col"], rows[0]["generation"], tuple(Segment(r["number"], r["path"], r["n_docs"], r["n_tokens"], tuple(r["gone"])) for r in rows))


def created(docs: DataFrame, root: str, fields: tuple[str, ...], id_col: str, shelves: int = SHELVES, block: int = BLOCK) -> Index:
    """An index of `docs`, one row an id, in a new folder."""
    spark = docs.sparkSession
    return committed(Index(spark, root, fields, id_col, 0, (write_segment(spark, root, 0, docs, fields, shelves, block),)))


def marked(index: Index, ids: DataFrame) -> tuple[Segment, ...]:
    """The segments with the documents of these ids gone."""
    path = f"{index.root}/gone/{uuid.uuid4().hex}"
    index.docs().join(ids.select(index.id_col).distinct(), index.id_col, "left_semi").select("doc", "segment").write.partitionBy("segment").parquet(path)
    touched = {r["segment"] for r in index.spark.read.schema("doc long, segment int").parquet(path).select("segment").distinct().collect()}  # segments' numbers
    return tuple(replace(s, gone=(*s.gone, f"{path}/segment={s.number}")) if s.number in touched else s for s in index.segments)


def added(index: Index, docs: DataFrame, shelves: int = SHELVES, block: int = BLOCK) -> Index:
    """`docs` join the index; a document of an id that it has is replaced."""
    segments = marked(index, docs)
    new = write_segment(index.spark, index.root, 1 + max(s.number for s in segments), docs, index.fields, shelves, block)
    return committed(replace(index, generation=index.generation + 1, segments=(*segments, new)))


def deleted(index: Index, ids: DataFrame) -> Index:
    return committed(replace(index, generation=index.generation + 1, segments=marked(index, ids)))


def tier(n_docs: int) -> int:
    return int(math.log(max(n_docs, 1), TIER))


def merged(index: Index, most: int = TIER, shelves: int = SHELVES, block: int = BLOCK) -> Index:
    """Where `most` segments or more are of one size, their live documents are written as one segment; again, until no size has so many.

    A document is rewritten once a tier, so a logarithmic number of times over the life of an index."""
    by_tier: dict[int, list[Segment]] = {}
    for s in index.segments:
        by_tier.setdefault(tier(s.n_docs), []).append(s)
    many = next((group for _, group in sorted(by_tier.items()) if len(group) >= most), None)
    if many is None:
        return index
    new = joined(index, many, shelves, block)
    rest = tuple(s for s in index.segments if s not in many)
    return merged(committed(replace(index, generation=index.generation + 1, segments=(*rest, new))), most, shelves, block)


def joined(index: Index, many: list[Segment], shelves: int, block: int) -> Segment:
    """The live documents of several segments as a new one.

    Each segment's numbers go on after the last block of the one before, so blocks stay whole and postings keep all but their number. Deletions
    leave blocks thin; where they are less than half full, numbers and postings are made anew from the texts."""
    spark, number = index.spark, 1 + max(s.number for s in index.segments)
    gone = {s.number: spark.read.parquet(*s.gone).distinct() for s in many if s.gone}
    gone = {k: F.broadcast(g) if g.count() <= SENT else g for k, g in gone.items()}
    live = lambda s, rows: rows.join(gone[s.number], "doc", "left_anti") if s.number in gone else rows
    pads_of = [f"pad_{f}" for f in index.fields]
    docs = [live(s, read(spark, s, "padded").drop("segment", *pads_of)) for s in many]
    blocks = union([d.select(F.lit(s.number).alias("segment"), F.floor(F.col("doc") / block).alias("block")) for s, d in zip(many, docs)]).groupBy("segment", "block").agg(F.count("*").alias("n"))
    full = {r["segment"]: r for r in blocks.groupBy("segment").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.max("block").alias("last")).collect()}  # a row a segment
    if sum(r["n"] for r in full.values()) * 2 < sum(r["blocks"] for r in full.values()) * block:
        return write_segment(spark, index.root, number, union(docs).drop("doc", "n_tokens"), index.fields, shelves, block)
    starts = dict(zip((s.number for s in many), accumulate((full[s.number]["last"] + 1 if s.number in full else 0 for s in many), initial=0)))
    moved = lambda s, rows: rows.withColumn("doc", F.col("doc") + starts[s.number] * block)
    path = f"{index.root}/segments/{number}-{uuid.uuid4().hex}"
    union([moved(s, d) for s, d in zip(many, docs)]).write.options(**ENCODED).option("parquet.block.size", LOT // 2).parquet(f"{path}/padded")
    names = [c.split()[0] for c in TERM_ROW.split(", ")]
    return shelved(spark, path, number, union([moved(s, live(s, read(spark, s, "postings").select(names))) for s in many]), shelves, block)


# ---- reading ------------------------------------------------------------------------------------------------------------


def words_of(phrases: Iterable[Phrase]) -> list[tuple[str, bool]]:
    """Each word of the phrases, and whether it is a prefix: the last of a phrase may be."""
    return [(w, p.prefix and j == len(p.words) - 1) for p in phrases for j, w in enumerate(p.words)]


def slots(rows: DataFrame, phrases: list[Phrase]) -> DataFrame:
    """`rows` of a term once for each phrase and place in it (p, j) that the term can stand at."""
    wanted = [(w, p.prefix and j == len(p.words) - 1, i, j) for i, p in enumerate(phrases) for j, w in enumerate(p.words)]
    at = [F.when(is_word(F.col("term"), w, prefix), F.struct(F.lit(i).alias("p"), F.lit(j).alias("j"))) for w, prefix, i, j in wanted]
    return rows.select("*", F.explode(F.array_compact(F.array(*at))).alias("at")).select(*rows.columns, "at.p", "at.j")


def phrase_counts(index: Index, phrases: list[Phrase], weights: dict[str, float], blocks: DataFrame | None = None) -> DataFrame:
    """(segment, doc, n_tokens, f): by live document that has one, the weighted occurrences of each phrase, in an array.

    A phrase stands where its words' places, each less its place in the phrase, meet: the lists are intersected by field.
    `blocks` (segment, block): only these are read."""
    used = {i: weights[f] for i, f in enumerate(index.fields) if weights.get(f, 0) > 0}
    rows = index.rows("postings", words_of(phrases)).filter(F.col("field").isin(list(used)))
    if blocks is not None:
        rows = rows.join(blocks, ["segment", "block"], "left_semi")
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in used.items() for x in pair)), F.col("field"))
    at = slots(rows.select("segment", "doc", "n_tokens", "field", "term", "places"), phrases)
    long = [i for i, p in enumerate(phrases) if len(p.words) > 1]
    found = (at.filter(~F.col("p").isin(long)) if long else at).select("segment", "doc", "n_tokens", "p", (weight * F.size("places")).alias("w"))
    if long:
        starts = at.filter(F.col("p").isin(long)).select("segment", "doc", "n_tokens", "field", "p", "j", F.transform("places", lambda x: x - F.col("j")).alias("starts"))
        met = starts.groupBy("segment", "doc", "n_tokens", "field", "p").agg(F.collect_list(F.struct("j", "starts")).alias("all"))
        of = lambda j: F.flatten(F.transform(F.filter("all", lambda x: x["j"] == j), lambda x: x["starts"]))
        size = F.lit(0)
        for i in long:
            size = F.when(F.col("p") == i, F.size(reduce(F.array_intersect, [of(j) for j in range(len(phrases[i].words))]))).otherwise(size)
        found = found.union(met.select("segment", "doc", "n_tokens", "p", (weight * size).alias("w")).filter("w > 0"))
    sums = [F.coalesce(F.sum(F.when(F.col("p") == i, F.col("w"))), F.lit(0.0)) for i in range(len(phrases))]
    return found.groupBy("segment", "doc").agg(F.first("n_tokens").alias("n_tokens"), F.array(*sums).alias("f"))


def unit_holds(unit: Unit, phrases: list[Phrase], f: Column) -> Column:
    return search.any_of([f[phrases.index(p)] > 0 for p in unit.phrases])


def wanted(query: Parsed, phrases: list[Phrase], f: Column) -> Column:
    loose = [unit_holds(u, phrases, f) for u in query.optional]
    return search.all_of([unit_holds(u, phrases, f) for u in query.required] + ([search.any_of(loose)] if loose else []))


def coverage_of(query: Parsed, phrases: list[Phrase], f: Column) -> Column:
    return sum((unit_holds(u, phrases, f).cast("int") for u in query.optional), F.lit(0))


def idfs(n: int, frequencies: list[int]) -> list[float]:
    values = [math.log((n - k + 0.5) / (k + 0.5)) for k in frequencies]
    return [v if v > 0 else LEAST_IDF for v in values]


def score_of(query: Parsed, phrases: list[Phrase], idf: list[float], mean: float, f: Column, size: Column) -> Column:
    score = F.lit(0.0)
    for p in query.phrases():  # a phrase that stands in two units counts twice
        i = phrases.index(p)
        score = score - idf[i] * f[i] * (K1 + 1) / (f[i] + K1 * (1 - B + B * size / mean))
    return score


def distinct_phrases(query: Parsed) -> list[Phrase]:
    return list(dict.fromkeys(query.phrases()))


def frequencies(index: Index, phrases: list[Phrase], weights: dict[str, float]) -> list[int]:
    """Live documents that have each phrase in a field of some weight: the heads say it of words in one field, the postings of all else."""
    used = [i for i, f in enumerate(index.fields) if weights.get(f, 0) > 0]
    if len(used) == 1 and not any(len(p.words) > 1 or p.prefix for p in phrases) and not any(s.gone for s in index.segments):
        heads = index.rows("heads", words_of(phrases)).filter(F.col("field") == used[0])
        seen = {r["term"]: r["n"] for r in heads.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the query's words
        return [seen.get(p.words[0], 0) for p in phrases]
    counts = phrase_counts(index, phrases, weights)
    return list(counts.agg(*(F.count_if(F.col("f")[i] > 0) for i in range(len(phrases)))).first())


def hits(index: Index, query: Parsed, scoring: Scoring, idf: list[float], mean: float, blocks: DataFrame | None = None) -> DataFrame:
    """(segment, doc, coverage, score) of the documents that match."""
    phrases = distinct_phrases(query)
    rows = phrase_counts(index, phrases, scoring.weights, blocks).filter(wanted(query, phrases, F.col("f")))
    return rows.select("segment", "doc", coverage_of(query, phrases, F.col("f")).alias("coverage"), score_of(query, phrases, idf, mean, F.col("f"), F.col("n_tokens")).alias("score"))


def scored(index: Index, query: Parsed, scoring: Scoring) -> DataFrame:
    """The documents that match, with their own columns, `coverage` and `score`, as `search.scored` has them."""
    n, mean = index.figures()
    idf = idfs(n, frequencies(index, distinct_phrases(query), scoring.weights))
    return index.docs().join(hits(index, query, scoring, idf, mean), ["segment", "doc"]).drop("segment", "doc")


def block_bounds(index: Index, query: Parsed, scoring: Scoring, idf: list[float], mean: float) -> DataFrame:
    """(segment, block, coverage, score): what no document of the block is better than; blocks that cannot match are left out."""
    phrases = distinct_phrases(query)
    used = {i: scoring.weights[f] for i, f in enumerate(index.fields) if scoring.weights.get(f, 0) > 0}
    weight = F.element_at(F.create_map(*(F.lit(x) for pair in used.items() for x in pair)), F.col("field"))
    at = slots(index.rows("heads", words_of(phrases)).filter(F.col("field").isin(list(used))), phrases)
    sums = [[F.coalesce(F.sum(F.when((F.col("p") == i) & (F.col("j") == j), weight * F.col("most"))), F.lit(0.0)) for j in range(len(p.words))] for i, p in enumerate(phrases)]
    f = F.array(*(F.least(*s) if len(s) > 1 else s[0] for s in sums))
    rows = at.groupBy("segment", "block").agg(f.alias("f"), F.min("least").alias("least")).filter(wanted(query, phrases, F.col("f")))
    # a score rises with a phrase's count and falls with the size; a little is left for the order of sums
    score = score_of(query, phrases, idf, mean, F.col("f"), F.col("least")) - 1e-9
    return rows.select("segment", "block", coverage_of(query, phrases, F.col("f")).alias("coverage"), score.alias("score"))


def top(index: Index, query: Parsed, scoring: Scoring, k: int, newest: str, where: Column | None = None, wave: int = WAVE, told: dict | None = None) -> DataFrame:
    """The first `k` documents in the order of relevance, of blocks that may hold one.

    The blocks of best bounds are scored first; the k-th of their documents says how good a block must be to be scored at
    all. A block is passed over only if its bound is strictly worse, so ties are settled among all that tie. `told` gets
    the numbers of blocks and of those scored."""
    n, mean = index.figures()
    phrases = distinct_phrases(query)
    idf = idfs(n, frequencies(index, phrases, scoring.weights))
    by_coverage = len(query.optional) > 1
    bounds = block_bounds(index, query, scoring, idf, mean)
    if not by_coverage:
        bounds = bounds.withColumn("coverage", F.lit(0))
    own = index.docs()

    def found(blocks: DataFrame) -> DataFrame:
        rows = own.join(hits(index, query, scoring, idf, mean, blocks), ["segment", "doc"])
        return rows.filter(where) if where is not None else rows

    order = search.ranked(own, query, newest, index.id_col)
    first = bounds.orderBy(F.desc("coverage"), "score", "segment", "block").limit(wave)
    first = index.spark.createDataFrame(first.select("segment", "block").collect(), "segment int, block long")  # `wave` rows
    ahead = found(F.broadcast(first)).orderBy(*order).limit(k).select("coverage", "score").collect()
    rest = bounds.join(F.broadcast(first), ["segment", "block"], "left_anti")
    if len(ahead) == k:
        worst = ahead[-1]
        as_good = F.col("score") <= worst["score"]
        if by_coverage:
            as_good = (F.col("coverage") > worst["coverage"]) | (F.col("coverage") == worst["coverage"]) & as_good
        rest = rest.filter(as_good)
    if told is not None:
        told["blocks"], told["scored"] = bounds.count(), first.count() + rest.count()
    return found(first.union(rest.select("segment", "block"))).orderBy(*order).limit(k).drop("segment", "doc")


def vocabulary(index: Index) -> DataFrame:
    """term, doc, cnt over live documents and all fields, from the postings alone: a document counts where its first posting of the term is."""
    rows = union([alive(index.spark, s, read(index.spark, s, "postings").select("term", "doc", "places", "first")) for s in index.segments])
    return rows.groupBy("term").agg(F.count_if("first").alias("doc"), F.sum(F.size("places")).alias("cnt"))
