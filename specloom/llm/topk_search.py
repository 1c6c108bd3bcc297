"""Exact top-k by inner product: a table of distances to pivots eliminates candidates.

For whole vectors q and x, 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2. The distance of two vectors is at least
the difference of their distances to any pivot; the greatest such bound over all pivots gives the
greatest score that x can have with q. Distances to the pivots are computed once for each vector and
stored with it. Candidates are then taken in the order of their bounds, in runs that grow, and a query
is finished when its next bound lies below the score of its k-th best; what is left is eliminated.
Scores are integers and exact; bounds are widened by more than floating point can lose.

Vectors lie in blocks of bounded size, queries in groups. Each group goes with each block to one of many
tasks, which keeps a group's best so far from block to block, so that the first blocks make the later ones
cheap; a task sends out at most k rows a query. No distance is stored for a pair. Pivots are taken from a
sample of `SAMPLE` vectors, each the one farthest from those before; they decide speed only.

Defined cases: a vector that is null or has a null, NaN or infinite component takes no part; a component
beyond 16,384 raises, as products would not be exact; of vectors of different lengths the shorter one
counts as ended by zeros; ties go to the smaller vec_id, nulls last (a null id is never a query); rows that
repeat a vec_id are queries and candidates of their own, and a query leaves out its own row only; fewer
than k others: all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MAX_LONG, cut, order_key
from .va_clustering import integers

K, SCALE, PIVOTS, SAMPLE = 20, 64, 32, 2048
BLOCK, GROUP, STRIP, FIRST_RUN = 4096, 1024, 64, 64
BLOCKS = pa.schema([("n", pa.int32()), *((c, pa.binary()) for c in ("ids", "rows", "v", "table"))])


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    if not len(sample):
        return sample
    chosen, nearest = [int((sample.astype(np.float64) ** 2).sum(axis=1).argmax())], np.full(len(sample), np.inf)
    while len(chosen) < min(pivots, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]).astype(np.float64) ** 2).sum(axis=1))
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def _padded(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows of a matrix, ended by zeros."""
    lengths, values = np.asarray(column.value_lengths(), np.int64), np.asarray(column.flatten(), np.int32)
    out = np.zeros((len(column), dims), np.int32)
    out[np.arange(dims) < lengths[:, None]] = values
    return out


def _block(ids: np.ndarray, rows: np.ndarray, v: np.ndarray, pivots: np.ndarray) -> pa.RecordBatch:
    """Vectors in the order of their ids, with their distances to the pivots."""
    order = np.lexsort((rows, ids))
    x, p = v[order].astype(np.float64), pivots.astype(np.float64)
    table = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * (x @ p.T) + (p * p).sum(axis=1))).astype(np.float32)
    blobs = (ids[order].tobytes(), rows[order].tobytes(), v[order].tobytes(), table.tobytes())
    return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs)], schema=BLOCKS)


class Block:
    def __init__(self, n: int, ids: bytes, rows: bytes, v: bytes, table: bytes):
        self.ids, self.rows = np.frombuffer(ids, np.int64), np.frombuffer(rows, np.int64)
        self.x = np.frombuffer(v, np.int32).reshape(n, -1).astype(np.float64)
        self.table = np.frombuffer(table, np.float32).reshape(n, -1)
        self.norms = (self.x * self.x).sum(axis=1)


class Best:
    """The k best candidates so far of each query of a group, and how many were evaluated."""

    def __init__(self, queries: Block, k: int):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.at, self.score, self.ids = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least, self.evaluated = np.full(n, -np.inf), np.zeros(n, np.int64)

    def _take(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates (query, score, id) that were evaluated: keep each query's best, ties by the smaller id."""
        good = score >= self.least[at]
        at, score, ids = at[good], score[good], ids[good]
        touched = np.zeros(len(self.least), bool)
        touched[at] = True
        old = touched[self.at]
        all_at, all_score, all_ids = (np.concatenate([a[old], b]) for a, b in ((self.at, at), (self.score, score), (self.ids, ids)))
        order = np.lexsort((all_ids, -all_score, all_at))
        all_at, all_score, all_ids = all_at[order], all_score[order], all_ids[order]
        starts = np.flatnonzero(np.concatenate([[True], all_at[1:] != all_at[:-1]])) if len(all_at) else np.empty(0, np.int64)
        rank = np.arange(len(all_at)) - np.repeat(starts, np.diff([*starts, len(all_at)]))
        full = rank == self.k - 1
        self.least[all_at[full]] = all_score[full]
        kept = rank < self.k
        self.at, self.score, self.ids = (np.concatenate([a[~old], b[kept]]) for a, b in ((self.at, all_at), (self.score, all_score), (self.ids, all_ids)))

    def search(self, block: Block) -> None:
        for a in range(0, len(self.q.ids), STRIP):
            self._strip(block, a, min(len(self.q.ids), a + STRIP))

    def _strip(self, block: Block, a: int, b: int) -> None:
        q, n = self.q, len(block.ids)
        table = q.table[a:b]
        apart = np.zeros((b - a, n), np.float32)
        for p in range(table.shape[1]):
            np.maximum(apart, np.abs(table[:, p, None] - block.table[None, :, p]), out=apart)
        both = q.norms[a:b, None] + block.norms
        slack = 1e-6 * np.sqrt(2 * both)  # far above the error of distances in single precision
        bound = (both - np.maximum(0, apart - 4 * slack) ** 2) / 2 + 1e-9 * both
        own = np.isin(q.rows[a:b], block.rows)
        for i in np.flatnonzero(own):
            bound[i, block.rows == q.rows[a + i]] = -np.inf
        run = FIRST_RUN
        while True:
            alive = bound >= np.maximum(self.least[a:b, None], np.finfo(float).min)
            left = alive.sum(axis=1)
            if not left.any():
                return
            some = np.flatnonzero(left)
            if 4 * run >= n:  # all that is left
                score = q.x[a + some] @ block.x.T
                i, c = np.nonzero(alive[some] & (score >= self.least[a + some, None]))
                self.evaluated[a + some] += left[some]
                self._take(a + some[i], score[i, c], block.ids[c])
                return
            first = np.argpartition(-bound[some], run, axis=1)[:, :run]
            i, j = np.nonzero(np.take_along_axis(alive[some], first, axis=1))
            c = first[i, j]
            score = np.einsum("ij,ij->i", q.x[a + some[i]], block.x[c])
            self.evaluated[a : b] += np.bincount(some[i], minlength=b - a)
            self._take(a + some[i], score, block.ids[c])
            bound[some[i], c] = -np.inf
            run *= 4

    def rows(self) -> Iterator[pa.RecordBatch]:
        """query row, query id, candidate's id, score; evaluated once for each query."""
        order = np.argsort(self.at, kind="stable")
        at, score, ids = self.at[order], self.score[order].astype(np.int64), self.ids[order]
        first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.q.rows[at], self.q.ids[at], ids, score, np.where(first, self.evaluated[at], 0))], names=["query_row", "query_id", "vec_id", "score", "evaluated"])


def _groups(rows: DataFrame, dims: int, pivots: np.ndarray, size: int) -> DataFrame:
    """The rows of each g as one block. g comes from a hash of the row and the count of rows, so a group holds about `size`."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        column = lambda i: t.column(i).combine_chunks()
        block = _block(np.asarray(column(1), np.int64), np.asarray(column(2), np.int64), _padded(column(3), dims), pivots)
        return pa.Table.from_batches([block]).add_column(0, "g", column(0)[:1].cast(pa.int64()))

    return rows.select("g", "id", "row", "v").groupBy("g").applyInArrow(run, "g bigint, n int, ids binary, rows binary, v binary, table binary")


def _blocks(rows: DataFrame, dims: int, pivots: np.ndarray, size: int) -> DataFrame:
    """The rows of each task in blocks of at most `size`: nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield _block(np.asarray(part.column(0), np.int64), np.asarray(part.column(1), np.int64), _padded(part.column(2), dims), pivots)

    return rows.select("id", "row", "v").mapInArrow(run, "n int, ids binary, rows binary, v binary, table binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, pivots: int = PIVOTS, block: int = BLOCK, group: int = GROUP, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score and evaluated (how many candidates the query met): the k best of every row for which is_query (a condition on vec_id) holds."""
    spark = vectors.sparkSession
    known = cut(integers(vectors, scale, id_column, vector_column), "search-vectors")
    kind = known.schema["vec_id"].dataType
    size = known.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_if(is_query)).first()
    dims, groups = max(1, size[0]), max(1, math.ceil(size[1] / group))
    sample = known.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()  # SAMPLE vectors
    chosen = choose_pivots(_padded(pa.array([r["v"] for r in sample], pa.list_(pa.int64())), dims), pivots)
    rows = known.withColumn("id", order_key("vec_id"))
    asked = _groups(rows.where(is_query).withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups))), dims, chosen, group)
    salts = max(1, math.ceil(4 * spark.sparkContext.defaultParallelism / groups))
    everything = cut(_blocks(rows, dims, chosen, block), "search-blocks").withColumn("salt", F.pmod(F.xxhash64("rows"), F.lit(salts)))
    parts = [
        cut(asked, "search-queries").select("*", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")).alias("salt"), F.lit(False).alias("candidates")),
        everything.select(F.explode(F.expr(f"sequence(0L, {groups - 1}L)")).alias("g"), "n", "ids", "rows", "v", "table", "salt", F.lit(True).alias("candidates")),
    ]
    dealt = parts[0].unionByName(parts[1]).repartition(min(groups * salts, 20_000), "g", "salt").sortWithinPartitions("g", "salt", "candidates")

    def run(batches):
        here, best = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["g"], r["salt"]) != here:
                    if best:
                        yield from best.rows()
                    here, best = (r["g"], r["salt"]), None
                found = Block(r["n"], r["ids"], r["rows"], r["v"], r["table"])
                if not r["candidates"]:
                    best = Best(found, k)
                elif best:
                    best.search(found)
        if best:
            yield from best.rows()

    found = dealt.mapInArrow(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint, evaluated bigint")
    of_query = Window.partitionBy("query_row")
    ranked = found.withColumn("rank", F.row_number().over(of_query.orderBy(F.desc("score"), "vec_id"))).withColumn("evaluated", F.sum("evaluated").over(of_query))
    name = lambda c: F.when(F.col(c) != MAX_LONG, F.col(c)).cast(kind).alias(c)
    return ranked.where(F.col("rank") <= k).select(name("query_id"), "rank", name("vec_id"), "score", "evaluated")
