"""Centroid clustering over a VA-file: few-bit cells decide most assignments, full vectors the rest.

Each vector gets a short approximation: for every dimension the number of a cell, `bits` bits wide.
Cells lie evenly between three standard deviations on either side of the mean, the outer ones reach
to the least and the greatest value of the table. In a round, a lookup table for each dimension gives
what a cell adds at least and at most to the squared distance from each centroid; their sums are an
interval per vector and centroid. A vector is assigned by its approximation if one interval ends before
all others begin; only the others fetch their full vector, by a join on the row.

The first and the last round read full vectors anyway (for the first sums and for the distances). In
between, sums move by the vectors that changed their cluster, so vectors that are decided and stay are
never read. All numbers are integers: sums, intervals and distances are exact.

Defined cases: a null vector, another number of components than `dims`, a null, NaN or infinite component
leave a row out; a component beyond 16,384 raises, as its squares would not be exact; ties of distance
go to the smaller centroid; rows that repeat a vec_id are vectors of their own and start in the order
of their components; a null vec_id never starts a centroid unless nothing else is left; with fewer
vectors than `k` each starts one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIMS, SCALE, K, ROUNDS, BITS = 64, 256, 40, 5, 6
LARGEST = 16_384  # of a component: squared distances stay below 2^53


def integers(vectors: DataFrame, scale: int, id_column: str, vector_column: str, dims: int | None = None) -> DataFrame:
    """vec_id, row, v: whole vectors of finite components, each turned into floor(scale * component)."""
    whole = F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.col(vector_column).cast("array<double>").alias("e"))
    rows = rows.where(whole if dims is None else whole & (F.size("e") == dims))
    large = F.raise_error(F.lit(f"a component is larger than {LARGEST}"))
    return rows.select("vec_id", "row", F.when(F.exists("e", lambda x: F.abs(x) > LARGEST), large).otherwise(F.transform("e", lambda x: F.floor(x * float(scale)))).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of lists of `dims` longs as rows of a matrix."""
    return np.asarray(column.flatten(), np.int64).reshape(-1, dims)


class Cells:
    """The cells of every dimension: the number of a component's cell, and the least and greatest component of a cell."""

    def __init__(self, stats: list, bits: int):
        inner = np.array([np.linspace(s["mean"] - 3 * s["dev"], s["mean"] + 3 * s["dev"], (1 << bits) - 1) for s in stats])
        self.bits, self.edges = bits, np.clip(np.floor(inner).astype(np.int64), [[s["low"]] for s in stats], [[s["high"]] for s in stats])
        self.low = np.concatenate([[[s["low"]] for s in stats], self.edges], axis=1)
        self.high = np.maximum(self.low, np.concatenate([self.edges - 1, [[s["high"]] for s in stats]], axis=1))

    def of(self, v: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, v[:, d], side="right") for d, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> pa.Array:
        bits = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :]
        packed = np.packbits(bits.reshape(len(cells), -1), axis=1)
        return pa.array([r.tobytes() for r in packed], pa.binary())

    def unpack(self, column: pa.Array) -> np.ndarray:
        dims = len(self.edges)
        data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        bits = np.unpackbits(data, axis=1)[:, : dims * self.bits].reshape(len(column), dims, self.bits)
        return bits @ (1 << np.arange(self.bits)[::-1])

    def tables(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By dimension, cell and centroid: what the cell adds at least and at most to the squared distance."""
        c, low, high = centroids.T[:, None, :], self.low[:, :, None], self.high[:, :, None]
        return np.maximum(0, np.maximum(low - c, c - high)) ** 2, np.maximum(np.abs(c - low), np.abs(c - high)) ** 2

    @staticmethod
    def decided(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The nearest centroid of each row, or -1 where intervals overlap."""
        least, most = (np.zeros((len(cells), t.shape[2]), np.int64) for t in tables)
        for d in range(cells.shape[1]):
            least += tables[0][d][cells[:, d]]
            most += tables[1][d][cells[:, d]]
        near = least <= most.min(axis=1, keepdims=True)
        return np.where(near.sum(axis=1) == 1, near.argmax(axis=1), -1)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact below 2^53."""
    x, c = v.astype(np.float64), centroids.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)


def _assign(v: np.ndarray, cells: np.ndarray, tables, centroids: np.ndarray) -> np.ndarray:
    cluster = Cells.decided(cells, tables)
    open_rows = np.flatnonzero(cluster < 0)
    cluster[open_rows] = distances(v[open_rows], centroids).argmin(axis=1)
    return cluster


STATE = "moved boolean, row bigint, cells binary, cluster int, sums array<bigint>, n bigint"


def _state(rows: pa.Array, cells: pa.Array, cluster: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), rows, cells, pa.array(cluster.astype(np.int32)), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())], names=["moved", "row", "cells", "cluster", "sums", "n"])


class _Moves:
    """Sums and counts that clusters win or lose in a task."""

    def __init__(self, k: int, dims: int):
        self.sums, self.n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)

    def add(self, v: np.ndarray, cluster: np.ndarray, sign: int = 1) -> None:
        np.add.at(self.sums, cluster, sign * v)
        np.add.at(self.n, cluster, sign)

    def rows(self) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.n.astype(bool) | self.sums.any(axis=1))
        m = len(some)
        sums = pa.array(self.sums[some].tolist(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(some.astype(np.int32)), sums, pa.array(self.n[some])], names=["moved", "row", "cells", "cluster", "sums", "n"])


class Clustering:
    """The rounds. `fetched` has, for each round between the first and the last, how many vectors it read in full."""

    def __init__(self, vectors: DataFrame, k: int = K, rounds: int = ROUNDS, bits: int = BITS, dims: int = DIMS, scale: int = SCALE, seed: int = 2, id_column: str = "vec_id", vector_column: str = "embedding"):
        self.dims, self.fetched = dims, []
        self.vectors = cut(integers(vectors, scale, id_column, vector_column, dims), "clustering-vectors")
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        starts = self.vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()  # k rows
        self.centroids = np.array([r["v"] for r in starts], np.int64).reshape(len(starts), dims)
        if not len(starts):
            return
        by_dim = self.vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim")
        stats = by_dim.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev")).orderBy("dim").collect()  # a row for each dimension
        self.cells = Cells(stats, bits)
        self.sums, self.n = np.zeros_like(self.centroids), np.zeros(len(self.centroids), np.int64)
        state = None
        for _ in range(rounds):
            state = self._round(state)

    def _round(self, state: DataFrame | None) -> DataFrame:
        """Assign all vectors, move sums and centroids; state and result have row, cells, cluster."""
        if state is None:
            moved = cut(self._first(), "clustering-moves", by=["moved"])
            done = None
        else:
            seen = cut(self._by_cells(state), "clustering-cells", by=["fetch"])
            done, wanted = seen.where("not fetch").select("row", "cells", "cluster"), seen.where("fetch")
            self.fetched.append(wanted.count())
            moved = cut(self._by_vectors(wanted), "clustering-moves", by=["moved"])
        self._move(moved)
        now = moved.where("not moved").select("row", "cells", "cluster")
        return now if done is None else done.unionByName(now)

    def _first(self) -> DataFrame:
        cells, centroids, dims = self.cells, self.centroids, self.dims

        def run(batches):
            tables, moves = cells.tables(centroids), _Moves(len(centroids), dims)
            for batch in batches:
                v = matrix(batch.column(1), dims)
                own = cells.of(v)
                cluster = _assign(v, own, tables, centroids)
                moves.add(v, cluster)
                yield _state(batch.column(0), cells.pack(own), cluster)
            yield from moves.rows()

        return self.vectors.select("row", "v").mapInArrow(run, STATE)

    def _by_cells(self, state: DataFrame) -> DataFrame:
        """row, cells, cluster, old; fetch where intervals overlap or the cluster changes."""
        cells, centroids = self.cells, self.centroids

        def run(batches):
            tables = cells.tables(centroids)
            for batch in batches:
                if not batch.num_rows:
                    continue
                old = np.asarray(batch.column(2))
                cluster = Cells.decided(cells.unpack(batch.column(1)), tables).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cluster), pa.array(old), pa.array(cluster != old)], names=["row", "cells", "cluster", "old", "fetch"])

        return state.mapInArrow(run, "row bigint, cells binary, cluster int, old int, fetch boolean")

    def _by_vectors(self, wanted: DataFrame) -> DataFrame:
        """Of rows whose vector is fetched: the cluster, and what clusters win and lose."""
        centroids, dims = self.centroids, self.dims

        def run(batches):
            moves = _Moves(len(centroids), dims)
            for batch in batches:
                if not batch.num_rows:
                    continue
                v, old = matrix(batch.column(4), dims), np.asarray(batch.column(3), np.int64)
                cluster = np.array(batch.column(2), np.int64)
                open_rows = np.flatnonzero(cluster < 0)
                cluster[open_rows] = distances(v[open_rows], centroids).argmin(axis=1)
                changed = cluster != old
                moves.add(v[changed], cluster[changed])
                moves.add(v[changed], old[changed], -1)
                yield _state(batch.column(0), batch.column(1), cluster)
            yield from moves.rows()

        return wanted.select("row", "cells", "cluster", "old").join(self.vectors.select("row", "v"), "row").mapInArrow(run, STATE)

    def _move(self, moved: DataFrame) -> None:
        sums = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(self.dims)]
        for r in moved.where("moved").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():  # at most k rows
            self.sums[r["cluster"]] += np.array(r[2:], np.int64)
            self.n[r["cluster"]] += r["n"]
        some = self.n > 0
        self.centroids = self.centroids.copy()
        self.centroids[some] = self.sums[some] // self.n[some, None]

    def result(self) -> DataFrame:
        """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, once more assigned."""
        spark = self.vectors.sparkSession
        if not len(self.centroids):
            return self.vectors.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        cells, centroids, dims = self.cells, self.centroids, self.dims

        def run(batches):
            tables = cells.tables(centroids)
            for batch in batches:
                v = matrix(batch.column(1), dims)
                cluster = _assign(v, cells.of(v), tables, centroids)
                distance = ((v - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

        kind = self.vectors.schema["vec_id"].dataType.simpleString()
        found = cut(self.vectors.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint"), "clustering-assigned")
        inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # at most k rows
        rows = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist()) if c in inertia]
        return found.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster(vectors: DataFrame, **options) -> DataFrame:
    return Clustering(vectors, **options).result()
