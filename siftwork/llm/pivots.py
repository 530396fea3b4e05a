"""Exact k-means on integer vectors with a LAESA pivot table.

A vector's distances to a few fixed pivots are computed once and stored beside it.  In every round
the centroids' distances to the same pivots are known too, and by the triangle inequality no vector
is nearer to a centroid than their largest difference over the pivots.  A vector's exact integer
distance is computed to the centroid of the smallest such bound first, and then only to centroids
whose bound does not exceed it.  Bounds are floating point and get a slack above their rounding
error; every distance that decides is an integer, ties go to the smaller centroid number, and new
centroids are floor(sum / count) of exact sums, so the result is the plain algorithm's, bit for bit.

Kept are vectors with exactly `width` components, none null, NaN or infinite; the others have no row
in the result.  A component x becomes floor(1024 x) (in double precision); beyond 2^27 in magnitude
(|x| >= 131,072) it is set to that limit, so that a squared distance always fits a long.  The first
centroids are the kept vectors of smallest sha256 of `<seed>:<vec_id>`, a null identifier after all
others; rows with one identifier follow the order of their bytes.  Repeated rows are vectors of
their own, fewer vectors than centroids are all centroids, and an empty table gives no rows.  Columns
other than the two named are not read.  A sum of distances that exceeds a long is null."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

WIDTH, CLUSTERS, ROUNDS, SEED = 64, 8, 10, 3
SCALE, LIMIT = 1024, 1 << 27
#: Pivots, and the vectors of smallest hash they are chosen from (a bound on a sample; pivots decide
#: how much is discarded, never the result).
PIVOTS, POOL = 12, 256
_ROWS = 1 << 14

_FOUND = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
_SUMS = pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("total", pa.int64()), ("members", pa.int64())])


def kept_vectors(vectors: DataFrame, id_column: str, vector: str, width: int) -> DataFrame:
    """(vec_id, v) of the usable rows; v holds the integers as little-endian 32-bit numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    @F.arrow_udf("binary")
    def integers(lists: pa.Array) -> pa.Array:
        x = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        whole = np.clip(x, -LIMIT, LIMIT).astype("<i4")
        return pa.Array.from_buffers(pa.binary(width * 4), len(lists), [None, pa.py_buffer(whole)]).cast(pa.binary())

    usable = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    usable = usable.filter((F.size("x") == width) & F.forall("x", finite))
    return usable.select("vec_id", integers("x").alias("v"))


def matrix(binary: pa.Array, width: int, kind: str = "<i4") -> np.ndarray:
    """The rows of a column of equally long binaries."""
    size = width * np.dtype(kind).itemsize
    fixed = binary.cast(pa.binary(size))
    return np.frombuffer(fixed.buffers()[1], kind, len(fixed) * width, fixed.offset * size).reshape(-1, width)


def euclidean(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows to all points, as doubles."""
    out = np.empty((len(rows), len(points)))
    for j, p in enumerate(points.astype(np.float64)):
        d = rows - p
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def choose_pivots(pool: np.ndarray, count: int) -> np.ndarray:
    """Vectors of the pool far from each other: each next one has the largest distance, summed over
    the pivots so far."""
    chosen = [0]
    away = np.zeros(len(pool))
    while len(chosen) < min(count, len(pool)):
        away += euclidean(pool, pool[chosen[-1:]])[:, 0]
        rest = away.copy()
        rest[chosen] = -1
        chosen.append(int(rest.argmax()))
    return pool[chosen]


def nearest(rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, and how many exact distances that took.  `table`
    holds the rows' distances to the pivots, `points` those of the centroids."""
    bound = np.zeros((len(rows), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - points[None, :, p]), out=bound)
    # Stored distances are rounded to single precision: half a unit in the last place on each side.
    bound -= table.max(1, initial=0.0, keepdims=True) * 2.0**-22 + points.max(initial=0.0) * 2.0**-22

    def exact(which: np.ndarray, c: int) -> np.ndarray:
        d = rows[which].astype(np.int64) - centroids[c]
        return np.einsum("ij,ij->i", d, d)

    first = bound.argmin(1)
    cluster, best, work = first.copy(), np.zeros(len(rows), np.int64), len(rows)
    for c in np.unique(first).tolist():
        own = np.flatnonzero(first == c)
        best[own] = exact(own, c)
    for c in range(len(centroids)):
        open_ = np.flatnonzero((first != c) & (bound[:, c] <= np.sqrt(best.astype(np.float64)) * (1 + 1e-12)))
        if not len(open_):
            continue
        work += len(open_)
        found = exact(open_, c)
        better = (found < best[open_]) | ((found == best[open_]) & (c < cluster[open_]))
        cluster[open_[better]], best[open_[better]] = c, found[better]
    return cluster, best, work


class Table:
    """The pivot table (vec_id, v, pivots) of the kept vectors, written once."""

    def __init__(self, vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", width: int = WIDTH, seed: int = SEED):
        self.spark, self.width = vectors.sparkSession, width
        self.work = Workspace(self.spark)
        kept = self.work.keep(kept_vectors(vectors, id_column, vector, width))
        named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        smallest = kept.orderBy(named.asc_nulls_last(), "v").limit(max(POOL, CLUSTERS)).collect()
        rank = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
        self.pool = np.array([np.frombuffer(r[1], "<i4") for r in sorted(smallest, key=rank)], np.int64).reshape(-1, width)
        self.pivots = choose_pivots(self.pool, PIVOTS) if len(self.pool) else self.pool
        pivots = self.pivots

        @F.arrow_udf("binary")
        def distances(v: pa.Array) -> pa.Array:
            found = euclidean(matrix(v, width), pivots).astype("<f4")
            size = len(pivots) * 4
            return pa.Array.from_buffers(pa.binary(size), len(v), [None, pa.py_buffer(found)]).cast(pa.binary())

        self.rows = self.work.keep(kept.withColumn("pivots", distances("v"))) if len(self.pool) else kept

    def _assign(self, centroids: np.ndarray):
        """For a task: (record batch, components, centroid, distance) of slices of its rows."""
        width, pivots = self.width, self.pivots
        points = euclidean(centroids, pivots)

        def assign(batch: pa.RecordBatch) -> Iterator[tuple]:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                rows = matrix(part["v"], width)
                table = matrix(part["pivots"], len(pivots), "<f4").astype(np.float64)
                yield part, rows, *nearest(rows, table, centroids, points)[:2]

        return assign

    def round(self, centroids: np.ndarray) -> np.ndarray:
        """The centroids after one round; an empty one stays.  A task gives one sum per centroid
        and component, so a centroid with most of the vectors is no hot key."""
        assign, width = self._assign(centroids), self.width

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals, members = np.zeros((len(centroids), width), np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                for _, rows, cluster, _ in assign(batch):
                    for c in np.unique(cluster).tolist():
                        own = cluster == c
                        totals[c] += rows[own].sum(0, dtype=np.int64)
                        members[c] += int(own.sum())
            c, place = np.divmod(np.arange(totals.size), width)
            columns = [c, place, totals.reshape(-1), members[c]]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _SUMS, strict=True)], schema=_SUMS)

        made = self.rows.select("v", "pivots").mapInArrow(sums, "cluster int, place int, total bigint, members bigint")
        exact = F.sum(F.col("total").cast("decimal(38,0)"))
        merged = made.groupBy("cluster", "place").agg(exact.alias("total"), F.sum("members").alias("members"))
        out = centroids.copy()
        for row in merged.filter("members > 0").collect():  # centroids x components
            out[row["cluster"], row["place"]] = int(row["total"]) // row["members"]
        return out

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """(vec_id, cluster, distance) of every kept vector."""
        assign = self._assign(centroids)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, cluster, distance in assign(batch):
                    columns = [part["vec_id"], pa.array(cluster, pa.int32()), pa.array(distance)]
                    yield pa.RecordBatch.from_arrays(columns, schema=_FOUND)

        return self.rows.mapInArrow(rows, "vec_id bigint, cluster int, distance bigint")


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding",
    clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = SEED,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    if not 1 <= clusters <= POOL:
        raise ValueError(f"1 to {POOL} clusters")
    table = Table(vectors, id_column, vector, width, seed)
    centroids = table.pool[:clusters]
    if not len(centroids):
        none = table.rows.select("vec_id")
        empty = {"cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
        return none.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})
    for _ in range(rounds):
        after = table.round(centroids)
        if (after == centroids).all():  # the remaining rounds change nothing
            break
        centroids = after
    found = table.work.keep(table.assigned(centroids))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    totals = {row["cluster"]: int(row["total"]) for row in sums}  # one row per centroid
    fits = lambda n: n if n < 1 << 63 else None
    whole = fits(sum(totals.values()))
    about = [(i, fits(totals.get(i, 0)), whole, digest(c)) for i, c in enumerate(centroids)]
    names = table.spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = found.join(F.broadcast(names), "cluster")
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
