"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Vectors get one more component, sqrt(M * M - |x| * |x|) with M the largest norm, so that the largest inner product is
the smallest distance. The tree is fitted on a bounded sample, by hash; every vector is then indexed in a leaf. Of n vectors
there are n / `LEAF` leaves, but sqrt(n) at most, so that leaves and their size grow together (`leaf_of`), and the sample has
`LEAST_SAMPLES` vectors a leaf, `SAMPLE` at least: 8 * sqrt(n) vectors are what the driver fits the tree on at any size. A
query walks the tree through a priority queue of node distances and visits leaves in that order. How many is calibrated:
for `CALIBRATE` queries the true neighbours among all other vectors are found by brute force, and visits widen until the
mean share of true neighbours in visited leaves reaches `RECALL`. A query is not its own neighbour there.

Equal vectors are folded first; only the k + 1 smallest ids of a vector can be in any result, so this loses nothing and
no vector is hot. Leaves stand on shelves of `BLOCK` vectors, a full leaf on one of its own in several blocks; queries come
in lots of `QUERIES`, once to a shelf with the leaves that they visit there. What is joined are blocks, not pairs of rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do null
ids, nor vectors of another length than the commonest (of equals the longest); repeated rows count once; equal scores go
to the smaller id; with k or fewer candidates all are returned; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, salt, salt_mask, salted

K, EVERY = 20, 20
SAMPLE, CALIBRATE, RECALL = 20_000, 200, 0.94
BRANCH, LEAF, LEAST_SAMPLES, ROUNDS = 16, 200, 8, 8
BLOCK, QUERIES = 4096, 512


class Tree:
    """Nodes in the order they were split: `kids[i]` is the slice of node i's children, or None for a leaf."""

    def __init__(self, sample: np.ndarray, leaf_size: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.centres = [sample.mean(0) if len(sample) else np.zeros(1)]
        self.kids: list[tuple[int, int] | None] = [None]
        todo = [(0, sample)]
        while todo:
            node, points = todo.pop(0)
            if len(points) <= leaf_size:
                continue
            centres, owner = k_means(points, min(BRANCH, -(-len(points) // leaf_size)), rng)
            if len(centres) < 2:
                continue
            first = len(self.centres)
            self.centres += list(centres)
            self.kids[node] = (first, first + len(centres))
            self.kids += [None] * len(centres)
            todo += [(first + i, points[owner == i]) for i in range(len(centres))]
        self.centres = np.array(self.centres)
        self.squares = (self.centres**2).sum(1)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.kids[node] is None or not len(rows):
                out[rows] = node
                continue
            a, b = self.kids[node]
            near = a + np.argmin(self.squares[a:b] - 2 * points[rows] @ self.centres[a:b].T, axis=1)
            todo += [(k, rows[near == k]) for k in range(a, b)]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """Leaves in the order of the priority queue."""
        away = self.squares - 2 * self.centres @ query
        heap, out = [(0.0, 0)], []
        while heap and len(out) < most:
            _, node = heapq.heappop(heap)
            if self.kids[node] is None:
                out.append(node)
            else:
                for k in range(*self.kids[node]):
                    heapq.heappush(heap, (away[k], k))
        return out

    def leaves(self) -> int:
        return sum(k is None for k in self.kids)


def k_means(points: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(ROUNDS):
        owner = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
        used = np.unique(owner)
        centres = np.array([points[owner == i].mean(0) for i in used])
    owner = np.argmin((centres**2).sum(1) - 2 * points @ centres.T, axis=1)
    used = np.unique(owner)
    return centres[used], np.searchsorted(used, owner)


def leaf_of(n: int, leaf_size: int) -> int:
    """Vectors a leaf for n vectors: `leaf_size`, or more where there would be over sqrt(n) leaves."""
    return max(leaf_size, math.isqrt(n))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm * norm - (x**2).sum(1), 0))[:, None]])


def unlifted(q: np.ndarray) -> np.ndarray:
    return np.hstack([q, np.zeros((len(q), 1))])


def valid(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)


def tops(queries: np.ndarray, q_ids: np.ndarray, vectors: np.ndarray, v_ids: np.ndarray, k: int) -> np.ndarray:
    """Rows (query, vector, score) of each query's k best, ties to smaller ids.

    The product of the blocks only proposes; the score of a pair is one sum over its components in a fixed order."""
    n = len(v_ids)
    if not n:
        return np.zeros(0, HITS)
    rough = queries @ vectors.T
    c = min(n, k + SLACK)
    at = np.argpartition(-rough, c - 1, axis=1)[:, :c] if c < n else np.tile(np.arange(n), (len(q_ids), 1))
    least = np.take_along_axis(rough, at, 1).min(1)
    out = np.zeros(at.shape, HITS)
    out["query"], out["vector"] = q_ids[:, None], v_ids[at]
    out["score"] = np.einsum("qd,qcd->qc", queries, vectors[at])
    if c < n:  # more are as good as the last: all of those take part
        for i in np.flatnonzero((rough >= (least - 1e-9 * np.abs(least))[:, None]).sum(1) > c):
            more = np.flatnonzero(rough[i] >= least[i] - 1e-9 * abs(least[i]))
            row = np.zeros(len(more), HITS)
            row["query"], row["vector"] = q_ids[i], v_ids[more]
            row["score"] = np.einsum("d,cd->c", queries[i], vectors[more])
            row = row[np.lexsort((row["vector"], -row["score"]))][:c]
            out[i] = row
    return best(out.ravel(), k)


def best(hits: np.ndarray, k: int) -> np.ndarray:
    """The k best rows of each query."""
    hits = hits[np.lexsort((hits["vector"], -hits["score"], hits["query"]))]
    first = np.flatnonzero(np.r_[True, hits["query"][1:] != hits["query"][:-1]]) if len(hits) else np.zeros(0, int)
    nth = np.arange(len(hits)) - np.repeat(first, np.diff(np.r_[first, len(hits)]))
    return hits[nth < k]


HITS = np.dtype([("query", np.int64), ("vector", np.int64), ("score", np.float64)])
#: Pairs proposed beyond the k best, for rounding; rows a task holds before it folds or passes them on.
SLACK, HELD = 4, 400_000
FOUND = "query long, vector long, score double"


def found(hits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(hits[c])) for c in HITS.names], list(HITS.names))


def folded(each: Iterator[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """What a task has found, with only the k best rows of a query passed on."""
    held: list[np.ndarray] = []
    for hits in each:
        held.append(hits)
        if sum(map(len, held)) > HELD:
            held = [best(np.concatenate(held), k)]
            if len(held[0]) > HELD // 2:
                yield found(held.pop())
    if held:
        yield found(best(np.concatenate(held), k))


def top(rows: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vector"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")


def brute_force(groups: DataFrame, queries: np.ndarray, q_ids: np.ndarray, k: int) -> DataFrame:
    """The k best of all rows for a bounded set of queries: every row is scored, in blocks."""
    shared = groups.sparkSession.sparkContext.broadcast((queries, q_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, ids = shared.value
        yield from folded((tops(qs, ids, matrix(b.column(1)), b.column(0).to_numpy(), k) for b in batches if b.num_rows), k)

    return top(groups.select("rep", "v").mapInArrow(run, FOUND), k)


def packed(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Rows (rep, v, leaves) as matrices by the columns `by`, at most `most` vectors a row: ids, components, and each
    vector's leaves as counts and numbers, in the order of the leaves and ids."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.assign(first=[x[0] for x in pdf.leaves]).sort_values(["first", "rep"])
        for at in range(0, len(pdf), most):
            part = pdf.iloc[at : at + most]
            counts, flat = np.fromiter(map(len, part.leaves), np.int32, len(part)), np.concatenate(part.leaves.to_list()).astype(np.int32)
            out.append((*key, part.rep.to_numpy(np.int64).tobytes(), np.stack(part.v.to_list()).astype(np.float64).tobytes(), counts.tobytes(), flat.tobytes()))
        return pd.DataFrame(out, columns=[*by, "ids", "m", "counts", "leaf"])

    return rows.groupBy(*by).applyInPandas(pack, ", ".join(f"{c} int" for c in by) + ", ids binary, m binary, counts binary, leaf binary")


def shelved(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """By leaf: its shelf and the blocks of that shelf. Small leaves share a shelf up to BLOCK vectors, a full one has its own, in blocks."""
    out, shelf, filled = {}, -1, BLOCK
    for leaf, n in sorted(sizes.items()):
        if filled + n > BLOCK:
            shelf, filled = shelf + 1, 0
        filled += n
        out[leaf] = (shelf, -(-n // BLOCK))
    return out


def met_on_a_shelf(row: list[bytes], k: int) -> Iterator[np.ndarray]:
    """A block of vectors and a lot of queries: each leaf's vectors against the queries that visit it."""
    ids, m, _, leaf, q_ids, q_m, q_counts, q_leaf = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.float64, np.int32, np.int32) * 2))
    m, q_m = m.reshape(len(ids), -1), q_m.reshape(len(q_ids), -1)
    visitor = np.repeat(np.arange(len(q_ids)), q_counts)
    starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    for at, end in zip(starts, [*starts[1:], len(leaf)]):
        here = visitor[q_leaf == leaf[at]]
        if len(here):
            yield tops(q_m[here], q_ids[here], m[at:end], ids[at:end], k)


def search(table: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE, calibrate: int = CALIBRATE, recall: float = RECALL, leaf_size: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k nearest of all others."""
    spark = table.sparkSession
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & valid(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size("v") == sizes["d"])
    # equal vectors as one, with the ids that can matter; the mask says into which parts its queries fall
    some = rows.withColumn("nth", F.dense_rank().over(W.partitionBy("v").orderBy("id"))).filter(F.col("nth") <= k + 1)
    groups = some.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_set("id")).alias("ids"))
    asked = rows.filter(F.col("id") % every == 0).withColumn("part", salt(F.col("id")))
    asked_of = asked.groupBy("v").agg(salt_mask(F.col("part")).alias("mask"))
    groups = materialize(groups.join(asked_of, "v", "left"), "vectors")
    n, norm = groups.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    leaf_size = leaf_of(n, leaf_size)
    sample = max(sample, LEAST_SAMPLES * (n // leaf_size))
    by_hash = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = groups.filter(by_hash < sample / n).select("v").toPandas() if n > sample else groups.select("v").toPandas()
    drawn = np.stack(drawn.v.to_list()) if len(drawn) else np.zeros((0, sizes["d"]))
    # leaves of `leaf_size` vectors, if the sample has enough for each
    tree = Tree(lifted(drawn, norm), max(LEAST_SAMPLES, int(leaf_size * len(drawn) / n)))
    shared = spark.sparkContext.broadcast((tree, norm))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, norm = shared.value
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tree.assign(lifted(matrix(b.column(1)), norm)))], ["rep", "v", "leaf"])

    indexed = materialize(groups.select("rep", "v").mapInArrow(index, "rep long, v array<double>, leaf int"), "leaves")
    shelves = shelved({r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()})  # a row a leaf of the tree
    # widen until the true neighbours of the calibration queries are in the visited leaves
    n_asked = groups.filter("mask IS NOT NULL").count()
    if not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = groups.filter(F.col("mask").isNotNull()).filter(by_hash < calibrate / n_asked).select("rep", "v").toPandas() if n_asked > calibrate else groups.filter("mask IS NOT NULL").select("rep", "v").toPandas()
    visits = tree.leaves()
    if len(some):
        qs, q_ids = np.stack(some.v.to_list()), some.rep.to_numpy(np.int64)
        others = top(brute_force(groups, qs, q_ids, k + 1).filter("query <> vector"), k)
        true = others.join(indexed.select(F.col("rep").alias("vector"), "leaf"), "vector").select("query", "leaf").collect()
        place = {q: {leaf: i for i, leaf in enumerate(tree.visits(v, tree.leaves()))} for q, v in zip(q_ids.tolist(), unlifted(qs))}
        ranks = sorted(place[r["query"]][r["leaf"]] for r in true)
        visits = ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)] + 1
    numbers = spark.sparkContext.broadcast(shelves)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tree, _), shelves = shared.value, numbers.value
        for b in batches:
            for i, q in enumerate(unlifted(matrix(b.column(1)))):
                by_shelf: dict[tuple[int, int], list[int]] = {}
                for leaf in tree.visits(q, visits):
                    shelf, n = shelves.get(leaf, (0, 0))
                    for block in range(n):
                        by_shelf.setdefault((shelf, block), []).append(leaf)
                one = b.slice(i, 1).take(pa.array(np.zeros(len(by_shelf), np.int64)))
                shelf, block = (pa.array([x[j] for x in by_shelf], pa.int32()) for j in (0, 1))
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), shelf, block, pa.array(list(by_shelf.values()), pa.list_(pa.int32()))], ["rep", "v", "shelf", "block", "leaves"])

    def of_leaf(which: int) -> Column:
        by_node = [str(shelves.get(i, (0, 0))[which]) for i in range(len(tree.kids))]
        return F.element_at(F.split(F.lit(",".join(by_node)), ",").cast("array<int>"), F.col("leaf") + 1)

    blocks = indexed.select("rep", "v", F.array("leaf").alias("leaves"), of_leaf(0).alias("shelf"), F.pmod(F.xxhash64("rep"), of_leaf(1)).cast("int").alias("block"))
    stored = packed(blocks, ["shelf", "block"], 2 * BLOCK)
    asks = groups.filter("mask IS NOT NULL").select("rep", "v").mapInArrow(plan, "rep long, v array<double>, shelf int, block int, leaves array<int>")
    asks = packed(asks.withColumn("lot", F.pmod(F.xxhash64("rep"), F.lit(max(1, n_asked // QUERIES))).cast("int")), ["shelf", "block", "lot"], QUERIES)
    columns = ("ids", "m", "counts", "leaf")
    met = stored.join(asks.select("shelf", "block", *(F.col(c).alias(f"q_{c}") for c in columns)), ["shelf", "block"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ([c[i].as_py() for c in b.columns] for b in batches for i in range(b.num_rows))
        yield from folded((hits for row in rows for hits in met_on_a_shelf(row, k + 1)), k + 1)

    hits = top(met.select(*columns, *(f"q_{c}" for c in columns)).mapInArrow(score, FOUND), k + 1)
    members = groups.select(F.col("rep").alias("vector"), "ids")
    one = F.struct((-F.col("score")).alias("far"), F.col("id").alias("id"))
    lists = hits.join(members, "vector").select("query", "score", F.explode("ids").alias("id")).groupBy("query").agg(F.slice(F.sort_array(F.collect_list(one)), 1, k + 1).alias("near"))
    answers = salted(groups.filter("mask IS NOT NULL").select("v", F.col("rep").alias("query"), "mask").join(lists, "query"), "mask", "part")
    each = asked.select("id", "v", "part").distinct().join(answers, ["v", "part"])
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return each.select(F.col("id").alias("query_id"), F.posexplode(near)).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"), (-F.col("col.far")).alias("score"))
