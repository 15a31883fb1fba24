"""Centroid clustering of integer vectors by exponion search, in exact arithmetic.

Vectors are kept in blocks of packed rows, written once. Beside each block a row of state holds, for
every vector, its centroid, an upper bound of the distance to it and a lower bound of the distance to
any other. In a round a vector whose upper bound is under its lower bound, or under half the distance
from its centroid to the nearest other, keeps its centroid unread. The others' upper bounds are made exact, and
if that does not settle them they scan the centroids inside a ball around their current one: with the exact distance
u and the distance s from the centroid to its nearest other, every centroid at u + s or nearer, among
them the two nearest, lies within 2 u + s. A list of centroids sorted by distance, one for each
centroid, gives the ball as a prefix; prefixes of like length (to the next power of two) are scanned
together. The radius is inclusive and rounded outwards, bounds are rounded to the safe side and must
hold strictly, so all that tie are compared, and the smaller number wins.

Blocks and their state are kept in hash buckets of the block's id, so a round moves no vector: it joins bucket by bucket,
writes the new state, and adds up each block's sums by centroid and component. Only the centroids
(at most ``MOST_CENTROIDS``) are on the driver and go to the tasks.

Distances are squared and fit 64 bits: components are held at ``limit(dims)`` either way. Where they are
small they are computed in doubles, which are exact up to 2**53.

Defined results: vectors that are null, of another number of components, or hold a null, NaN or
infinite one take no part; rows without an id take part but start no centroid; repeated rows are vectors
of their own and may start centroids of equal place, of which the smaller number wins; fewer vectors than centroids start as
many centroids as there are vectors; an empty centroid stays where it is; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bsi import quantised
from loomgraph.llm.common import cut, cut_bucketed, map_batches, read_table, release, shuffle_partitions
from loomgraph.llm.tokens import list_of

BLOCK_ROWS, MOST_CENTROIDS = 4096, 2048
#: What bounds and radii are widened by, for the rounding of roots and sums.
_SLACK = 1e-9
#: Differences formed at once.
_CELLS = 1 << 21


def limit(dims: int) -> int:
    """The greatest component for which a squared distance of ``dims`` components fits 62 bits."""
    return math.isqrt((1 << 62) // max(1, dims)) // 2


def kept_vectors(df: DataFrame, vec_id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, values) of the rows that take part, as integers floor(scale * x)."""
    most = F.lit(limit(dims))
    values = F.when(F.size(vector) == dims, quantised(vector, scale))
    held = F.transform("values", lambda v: F.greatest(F.least(v, most), -most).cast("int"))
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), values.alias("values")).where("values is not null").withColumn("values", held)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in their order; ties go by id and components."""
    named = vectors.where("vec_id is not null").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256))
    rows = named.orderBy("hash", "vec_id", "values").limit(k).collect()
    return np.array([r["values"] for r in rows], dtype=np.int64)


def _blocks(vectors: DataFrame, dims: int, block_rows: int) -> DataFrame:
    """The vectors packed by blocks, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                values = part.column(1).flatten().to_numpy().astype("<i4")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], type=pa.int32()), pa.concat_arrays([part.column(0)]))
                yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), ids, pa.array([values.tobytes()], type=pa.binary())], names=["block", "ids", "data"])

    return map_batches(vectors, run, "block string, ids array<long>, data binary")


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to those of ``y``, (len(x), len(y)), or pairwise where ``y`` is one a row."""
    wide = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0))) * 2
    if x.shape[1] * wide * wide >= 1 << 53:
        # Products may pass 64 bits on the way, but wrap, and the sum fits.
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None]
    a, b = x.astype(np.float64), y.astype(np.float64)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None]).astype(np.int64)


def _own_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    step = x - y
    return (step * step).sum(axis=1)


@dataclass
class Lists:
    """Centroids, and for each the others sorted by distance."""

    centroids: np.ndarray
    order: np.ndarray
    reach: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray) -> Lists:
        apart = squared(centroids, centroids)
        np.fill_diagonal(apart, -1)  # a centroid comes first in its own list, also before those of its place
        order = np.argsort(apart, axis=1, kind="stable")
        return cls(centroids, order, np.sqrt(np.maximum(np.take_along_axis(apart, order, axis=1), 0).astype(np.float64)))

    @property
    def nearest_other(self) -> np.ndarray:
        return self.reach[:, 1] if len(self.centroids) > 1 else np.full(1, np.inf)


def _best_two(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest of some centroids, ties by smaller number, and the next squared distance."""
    by_number = np.argsort(numbers)
    far = squared(x, centroids[numbers[by_number]])
    at = far.argmin(axis=1)
    rows = np.arange(len(x))
    least = far[rows, at]
    if len(numbers) == 1:
        return numbers[by_number][at], least, np.full(len(x), -1, dtype=np.int64)
    far[rows, at] = np.iinfo(np.int64).max
    return numbers[by_number][at], least, far.min(axis=1)


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, lists: Lists) -> int:
    """Move each vector to its nearest centroid, bounds with it, in place; gives the number of distances computed."""
    half = lists.nearest_other / 2
    open_ = np.flatnonzero(~(upper < np.maximum(lower, half[cluster])))
    if not len(open_):
        return 0
    exact = np.sqrt(_own_distance(x[open_], lists.centroids[cluster[open_]]).astype(np.float64))
    upper[open_] = exact * (1 + _SLACK)
    done = len(open_)
    still = ~(upper[open_] < np.maximum(lower[open_], half[cluster[open_]]))
    open_, exact = open_[still], exact[still]
    if not len(open_) or len(lists.centroids) == 1:
        return done
    own = cluster[open_]
    radius = (2 * exact + lists.nearest_other[own]) * (1 + _SLACK) + _SLACK
    inside = np.empty(len(open_), dtype=np.int64)
    for a in np.unique(own).tolist():
        mine = own == a
        inside[mine] = np.searchsorted(lists.reach[a], radius[mine], side="right")
    # Prefixes of like length are scanned together, each up to the next power of two.
    size = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(np.int64), len(lists.centroids))
    for a, n in np.unique(np.stack([own, size], axis=1), axis=0).tolist():
        rows = open_[(own == a) & (size == n)]
        numbers = lists.order[a, :n]
        step = max(1, _CELLS // (n * x.shape[1]))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            cluster[part], least, second = _best_two(x[part], lists.centroids, numbers)
            upper[part] = np.sqrt(least.astype(np.float64)) * (1 + _SLACK)
            lower[part] = np.sqrt(second.astype(np.float64)) * (1 - _SLACK)
        done += n * len(rows)
    return done


def moved_bounds(cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, moves: np.ndarray) -> None:
    """Bounds after the centroids moved so far, in place."""
    upper += moves[cluster] * (1 + _SLACK)
    if len(moves) > 1:
        first = int(moves.argmax())
        second = float(np.delete(moves, first).max())
        lower -= np.where(cluster == first, second, moves[first]) * (1 + _SLACK)


_STATE = "block string, cluster binary, upper binary, lower binary, scanned long, sums array<struct<cluster:int,n:long,total:array<long>>>"


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, moves: np.ndarray | None) -> DataFrame:
    """The state of all blocks after one assignment to ``centroids``."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists.of(centroids)
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_buffer(), dtype="<i4").reshape(-1, dims).astype(np.int64)
                if moves is None:
                    # Nothing is known yet: every bound is open, and every vector scans all centroids.
                    scanned = len(x) * len(centroids)
                    cluster, least, second = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
                    for at in range(0, len(x), step := max(1, _CELLS // (len(centroids) * dims))):
                        part = slice(at, at + step)
                        cluster[part], least[part], second[part] = _best_two(x[part], centroids, np.arange(len(centroids)))
                    upper = np.sqrt(least.astype(np.float64)) * (1 + _SLACK)
                    lower = np.sqrt(second.astype(np.float64)) * (1 - _SLACK) if len(centroids) > 1 else np.full(len(x), np.inf)
                else:
                    cluster = np.frombuffer(batch.column(2)[i].as_buffer(), dtype="<i4").astype(np.int64)
                    upper, lower = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype="<f8").copy() for c in (3, 4))
                    moved_bounds(cluster, upper, lower, moves)
                    scanned = search(x, cluster, upper, lower, lists)
                order = np.argsort(cluster, kind="stable")
                heads = np.flatnonzero(np.r_[True, np.diff(cluster[order]) != 0][: len(order)])
                totals, counts = np.add.reduceat(x[order], heads, axis=0), np.diff(np.r_[heads, len(order)])
                sums = pa.StructArray.from_arrays([pa.array(cluster[order][heads].astype(np.int32)), pa.array(counts.astype(np.int64)), list_of(totals.ravel(), np.full(len(heads), dims), pa.int64())], names=["cluster", "n", "total"])
                packed = [pa.array([v.tobytes()], type=pa.binary()) for v in (cluster.astype("<i4"), upper, lower)]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()]), *packed, pa.array([scanned], type=pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(heads)], type=pa.int32()), sums)], names=[c.split(" ")[0] for c in _STATE.split(", ")])

    whole = blocks.select("block", "data") if state is None else blocks.join(state.hint("merge"), "block").select("block", "data", "cluster", "upper", "lower")
    return map_batches(whole, run, _STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's exact floored mean; empty ones as they were."""
    own = state.select(F.explode("sums").alias("s")).select("s.cluster", "s.n", F.posexplode("s.total").alias("dim", "x"))
    new = centroids.copy()
    for r in own.groupBy("cluster", "dim").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        new[r.cluster, r.dim] = int(r.total) // r.n
    return new


@dataclass
class Clustering:
    """vec_id, cluster, distance of each vector; the final centroids; the distances computed by round."""

    vectors: DataFrame
    centroids: np.ndarray
    scanned: list[int]


_RESULT = "vec_id long, cluster int, distance long"


def cluster_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2, block_rows: int = BLOCK_ROWS) -> Clustering:
    """``rounds`` of assignment and exact floored means, and a last assignment."""
    if not 1 <= k <= MOST_CENTROIDS:
        raise ValueError(f"k must be from 1 to {MOST_CENTROIDS}, for the centroids go to every task")
    spark = df.sparkSession
    vectors = kept_vectors(df, vec_id, vector, dims, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], _RESULT), centroids, [])
    buckets = shuffle_partitions(spark)
    packed = cut(_blocks(vectors, dims, block_rows))
    blocks = cut_bucketed(packed.repartition(buckets, "block"), buckets, "block")
    release(packed)
    state, moves, scanned = None, None, []
    for _ in range(rounds + 1):
        before, state = state, cut_bucketed(_round(blocks, state, centroids, moves), buckets, "block")
        release(before)
        scanned.append(state.agg(F.sum("scanned")).first()[0])
        if len(scanned) > rounds:
            break
        new = _means(state, centroids)
        moves = np.sqrt(_own_distance(new, centroids).astype(np.float64))
        centroids = new

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cluster = np.frombuffer(batch.column(2)[i].as_buffer(), dtype="<i4")
                x = np.frombuffer(batch.column(1)[i].as_buffer(), dtype="<i4").reshape(-1, dims).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(cluster), pa.array(_own_distance(x, centroids[cluster]))], names=["vec_id", "cluster", "distance"])

    out = cut(map_batches(blocks.join(state.hint("merge"), "block").select("ids", "data", "cluster"), finish, _RESULT))
    release(blocks, state)
    return Clustering(out, centroids, scanned)


def with_inertia(found: Clustering) -> DataFrame:
    """The vectors with the sums of distances of their cluster and of all, and their centroid's digest."""
    if not len(found.centroids):
        return found.vectors.selectExpr("*", "cast(null as long) cluster_inertia", "cast(null as long) inertia", "cast(null as string) centroid_sha256")
    sums = {r.cluster: int(r.total) for r in found.vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    inside = lambda n: min(n, (1 << 63) - 1)
    rows = [(c, inside(n), inside(sum(sums.values())), digest[c]) for c, n in sums.items()]
    # One row a centroid.
    named = found.vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.vectors.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark, sf_dir: str) -> DataFrame:
    return with_inertia(cluster_vectors(read_table(spark, sf_dir, "embeddings")))
