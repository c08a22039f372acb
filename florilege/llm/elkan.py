"""Centroid clustering in exact integers, with the triangle inequality to skip distances (Elkan's bounds).

A vector keeps its cluster, an upper bound of the distance to its centroid and a lower bound for each of the k centroids.
When centroids move, the bounds move by as much. Centroid j is passed over for a vector if its lower bound, or half the
distance between j and the vector's own centroid, is above the upper bound; all other distances are computed. Squared
distances are exact integers; bounds are doubles, every root and sum of which is rounded outwards, so a bound never says
more than is true. A centroid is passed over only if it is strictly farther, so ties are always computed and go to
the smaller number: the clusters are those of computing every distance.

The vectors lie in blocks of `BLOCK`, a row each, with their bounds. A round is one map over the blocks that writes them anew in the
shared folder, with the sums and counts of the block's clusters beside; then these alone are read, summed by Spark, and the k new
centroids reach the driver. No vector is shuffled, nor leaves its block. What a round has read is deleted when the next is written.

Defined results: vectors that are null, of another length, or hold null or non-finite components (or one whose multiple by `SCALE` is) take no part; null
and repeated vec_ids are rows of their own, and of rows that tie for a first centroid the one of smaller components comes first; with fewer vectors
than k each starts a cluster; equal centroids leave all vectors to the smallest number; distances beyond a long are given as the largest long;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialize, tidy

K, ROUNDS, DIM, SCALE, SEED = 8, 10, 64, 1024, "3"
BLOCK = 4096
#: Factors that round a double outwards: more than the errors of a conversion, a root and a sum together.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48
LARGEST = (1 << 63) - 1


def usable(vectors: DataFrame, vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> Column:
    v = F.col(vector_col)
    wrong = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))
    return v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, wrong)


def first_centroids(kept: DataFrame, k: int = K, seed: str = SEED, scale: int = SCALE) -> list[list[int]]:
    """Components of the k vectors of smallest hash of their ids."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(h.alias("h"), F.col("v").cast("array<double>").alias("v"))
    return [[int(np.floor(scale * x)) for x in r["v"]] for r in rows.orderBy("h", "v").limit(k).collect()]


def exact(values: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which squared distances are exact: doubles where all numbers are small, else Python's integers."""
    reach = max(np.abs(values).max(initial=0), np.abs(centres).max(initial=0))
    # differences of 23 bits, squares of 46, and sums of `DIM` of them 52
    if reach <= 1 << 22 and values.shape[1] <= 64:
        return values.astype(np.float64), centres.astype(np.float64)
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape), centres


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(-1)


def roots(squares: np.ndarray, factor: float) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * factor


class Bounds:
    """Of a block: cluster, upper bound, lower bounds by centroid; `computed` counts exact distances."""

    def __init__(self, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        self.cluster, self.upper, self.lower, self.computed = cluster, upper, lower, 0

    @classmethod
    def unknown(cls, n: int, k: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.full(n, np.inf), np.zeros((n, k)))

    def moved(self, by: np.ndarray) -> None:
        """Centroid j has moved by at most by[j]."""
        self.upper = (self.upper + by[self.cluster]) * UP
        self.lower = np.maximum(self.lower - by, 0) * DOWN

    def assign(self, x: np.ndarray, centres: np.ndarray) -> None:
        """The nearest centroid of each vector, ties to the smaller number."""
        k = len(centres)
        half = np.array([roots(squared(centres, c), DOWN) / 2 for c in centres]).reshape(k, k)
        own = np.arange(k) == np.arange(k)[:, None]
        nearest_other = np.where(own, np.inf, half).min(1, initial=np.inf)
        todo = np.flatnonzero(self.upper >= nearest_other[self.cluster])

        def doubtful(rows: np.ndarray) -> np.ndarray:
            """By row and centroid: whether it may be as near as the row's own."""
            a, u = self.cluster[rows], self.upper[rows, None]
            return (self.lower[rows] <= u) & (half[a] <= u) & ~own[a]

        todo = todo[doubtful(todo).any(1)]
        # the distance to the own centroid is all that most of these need
        best = squared(x[todo], centres[self.cluster[todo]])
        self.computed += len(todo)
        self.upper[todo] = roots(best, UP)
        self.lower[todo, self.cluster[todo]] = roots(best, DOWN)
        for j in range(k):
            at = np.flatnonzero(doubtful(todo)[:, j])
            rows = todo[at]
            d = squared(x[rows], centres[j])
            self.computed += len(rows)
            self.lower[rows, j] = roots(d, DOWN)
            nearer = (d < best[at]) | (d == best[at]) & (j < self.cluster[rows])
            rows, at, d = rows[nearer], at[nearer], d[nearer]
            best[at], self.cluster[rows], self.upper[rows] = d, j, roots(d, UP)


def movement(before: list[list[int]], after: list[list[int]]) -> np.ndarray:
    d = np.array([sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(before, after)], object)
    return roots(d, UP)


def blocks(kept: DataFrame, k: int, scale: int = SCALE) -> DataFrame:
    """(ids, n, x, state): rows of up to `BLOCK` vectors as integers, nothing known of them yet."""
    kind = dict(kept.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.slice(at, BLOCK)
                n = len(part)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                ids = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column(0))
                state = packed(Bounds.unknown(n, k))
                yield pa.RecordBatch.from_arrays([ids, pa.array([n]), pa.array([x.tobytes()], pa.binary()), pa.array([state], pa.binary())], ["ids", "n", "x", "state"])

    return kept.mapInArrow(tidy(run), f"ids array<{kind}>, n long, x binary, state binary")


def packed(b: Bounds) -> bytes:
    return b.cluster.tobytes() + b.upper.tobytes() + b.lower.tobytes()


def unpacked(state: bytes, n: int, k: int) -> Bounds:
    return Bounds(np.frombuffer(state, np.int32, n).copy(), np.frombuffer(state, np.float64, n, 4 * n).copy(), np.frombuffer(state, np.float64, n * k, 12 * n).reshape(n, k).copy())


def assigned(state: DataFrame, centres: list[list[int]], by: np.ndarray | None, dim: int = DIM) -> DataFrame:
    """The blocks with every vector at its nearest centroid, with (sums, computed): by cluster its count and its sums of components,
    as decimals in one list; and the number of distances computed."""
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                n, values = b.column(1)[i].as_py(), np.frombuffer(b.column(2)[i].as_py(), np.float64).reshape(-1, dim)
                bounds = unpacked(b.column(3)[i].as_py(), n, k)
                if by is not None:
                    bounds.moved(by)
                x, c = exact(values, np.array(centres, object))
                bounds.assign(x, c)
                sums = []
                for j in range(k):
                    own = x[bounds.cluster == j]
                    sums += [len(own), *(int(s) for s in own.sum(0))] if len(own) else [0] * (dim + 1)
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:3], pa.array([packed(bounds)], pa.binary()), pa.array([list(map(str, sums))], pa.list_(pa.string())), pa.array([bounds.computed], pa.int64())],
                    ["ids", "n", "x", "state", "sums", "computed"],
                )

    kind = dict(state.dtypes)["ids"]
    return state.select("ids", "n", "x", "state").mapInArrow(tidy(run), f"ids {kind}, n long, x binary, state binary, sums array<string>, computed long")


def new_centroids(state: DataFrame, centres: list[list[int]], dim: int = DIM) -> list[list[int]]:
    """Componentwise floor of the means; a centroid without vectors stays. Only the blocks' sums are read."""
    sums = state.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    total = {r["at"]: int(r["s"]) for r in sums.collect()}  # k * (dim + 1) numbers
    out = []
    for j, centre in enumerate(centres):
        count, *parts = (total.get(j * (dim + 1) + i, 0) for i in range(dim + 1))
        out.append([p // count for p in parts] if count else centre)
    return out


def distances(state: DataFrame, centres: list[list[int]], dim: int = DIM) -> DataFrame:
    """vec_id, cluster, distance of each vector of the blocks."""
    k, kind = len(centres), dict(state.dtypes)["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                values = np.frombuffer(b.column(2)[i].as_py(), np.float64).reshape(-1, dim)
                cluster = unpacked(b.column(3)[i].as_py(), len(values), k).cluster
                x, c = exact(values, np.array(centres, object))
                d = [min(int(v), LARGEST) for v in squared(x, c[cluster])]
                yield pa.RecordBatch.from_arrays([b.column(0)[i].values, pa.array(cluster), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    return state.select("ids", "n", "x", "state").mapInArrow(tidy(run), f"vec_id {kind[6:-1]}, cluster int, distance long")


def cluster(
    vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding", computed: list[int] | None = None
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. `computed` gets the exact distances of each round."""
    spark = vectors.sparkSession
    kept = vectors.filter(usable(vectors, vector_col, dim, scale)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    centres = first_centroids(kept, k, seed, scale)
    if not centres:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return kept.filter("false").select(F.col("id").alias("vec_id"), *none)
    state, by = materialize(blocks(kept, len(centres), scale), "blocks"), None
    for turn in range(rounds + 1):
        state, before = materialize(assigned(state, centres, by, dim), "round"), state
        forget(before)
        if computed is not None:
            computed.append(state.agg(F.sum("computed")).first()[0])
        if turn < rounds:
            after = new_centroids(state, centres, dim)
            centres, by = after, movement(centres, after)
    rows = materialize(distances(state, centres, dim), "distances")
    forget(state)
    by_cluster = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    figures = [(j, min(by_cluster.get(j, 0), LARGEST), min(sum(by_cluster.values()), LARGEST), digests[j]) for j in range(len(centres))]
    table = spark.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> str:
    """SQL for the rows of `cluster`: every distance of every round."""
    d = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x FROM embeddings "
        f"WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS c, x FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, min(s).c AS c, min(s).d AS d FROM (SELECT v.r, {{'d': {d}, 'c': c.c}} AS s FROM v, c{i} c) GROUP BY r)")
        if i < rounds:
            ctes.append(
                f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT c, list(q ORDER BY i) AS x FROM (SELECT c, i, "
                f"(sum(e)::BIGINT - ((sum(e)::BIGINT % count(*)) + count(*)) % count(*)) // count(*) AS q "
                f"FROM (SELECT a.c, unnest(v.x) AS e, unnest(range({dim})) AS i FROM v JOIN a{i} a USING (r)) GROUP BY c, i) GROUP BY c) m ON m.c = c.c)"
            )
    return (
        f"WITH {', '.join(ctes)} SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, "
        f"sha256(array_to_string(f.x, ',')) AS centroid_sha256 FROM v JOIN a{rounds} a USING (r) JOIN c{rounds} f ON f.c = a.c"
    )
