"""Nearest neighbours by a block matrix join: int8 tiles bound every distance, survivors are computed again in double."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.functions.storage import cut
from tracelake.llm.common import table

#: Queries and candidates of a cell; a task holds its queries and one tile of products.
QUERIES, CANDIDATES, TILE = 4096, 1 << 17, 4096


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8, their scales, and the norms of what the rounding left out."""
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = unit - whole * scale[:, None]
    return whole, scale, np.sqrt((rest * rest).sum(axis=1))


class Cell:
    """One block of queries against a stream of candidates, all as int8 codes. For each query a heap holds the ``k`` best lower
    bounds of a cosine; a candidate whose upper bound is under the least of these is out."""

    def __init__(self, rows: np.ndarray, whole: np.ndarray, scale: np.ndarray, rest: np.ndarray, k: int) -> None:
        self.rows, self.scale, self.rest, self.k = rows, scale, rest, k
        # products of int8 numbers are exact in float32 up to 1040 dimensions, and float64 beyond
        self.kind = np.float32 if whole.shape[1] <= 1040 else np.float64
        self.whole = whole.astype(self.kind)
        self.heaps: list[list[float]] = [[] for _ in rows]
        self.floor = np.full(len(rows), -np.inf)
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, rows: np.ndarray, whole: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        for at in range(0, len(rows), TILE):
            own = slice(at, at + TILE)
            self._tile(rows[own], whole[own], scale[own], rest[own])

    def _tile(self, rows: np.ndarray, whole: np.ndarray, scale: np.ndarray, rest: np.ndarray) -> None:
        near = (self.whole @ whole.astype(self.kind).T) * (self.scale[:, None] * scale[None, :])
        error = rest[None, :] * (1 + self.rest[:, None]) + self.rest[:, None] * (1 + rest[None, :]) + 1e-9
        near[self.rows[:, None] == rows[None, :]] = -np.inf  # the query's own row
        low = near - error
        k = min(self.k, low.shape[1])
        best = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k :]
        for q in np.flatnonzero(best.max(axis=1) > self.floor).tolist():
            heap = self.heaps[q]
            for x in best[q].tolist():
                if x > -np.inf and len(heap) < self.k:
                    heapq.heappush(heap, x)
                elif heap and x > heap[0]:
                    heapq.heapreplace(heap, x)
            if len(heap) == self.k:
                self.floor[q] = heap[0]
        q, c = np.nonzero((near + error >= self.floor[:, None]) & (near > -np.inf))
        self.found.append((q, rows[c], low[q, c], (near + error)[q, c]))
        self.held += len(q)
        if self.held > 1 << 20:
            self._prune()

    def _prune(self) -> None:
        q, c, low, high = (np.concatenate(x) for x in zip(*self.found))
        keep = high >= self.floor[q]
        self.found, self.held = [(q[keep], c[keep], low[keep], high[keep])], 0

    def pairs(self) -> tuple[np.ndarray, ...]:
        """Rows of queries and of candidates that may be among their best, and the bounds."""
        if not self.found:
            return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0),) * 2
        self._prune()
        q, c, low, high = self.found[0]
        return self.rows[q], c, low, high


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        e, n = b.column(1), pa.compute.list_value_length(b.column(1)).to_numpy(zero_copy_only=False)
        for dim in np.unique(n).tolist():
            own = np.flatnonzero(n == dim)
            v = e.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            whole, scale, rest = quantise(v)
            codes = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * dim).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), pa.array(np.full(len(own), dim)), b.column(2).take(pa.array(own)), codes, pa.array(scale), pa.array(rest)], names=["row", "dim", "q", "code", "scale", "rest"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cell: Cell | None) -> Iterator[pa.RecordBatch]:
            if cell:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cell.pairs()], names=["asked", "row", "low", "high"])

        at, cell, held = None, None, []
        for b in batches:
            keys = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)  # dim, qb, cb, side
            cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist() + [b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                dim, qb, cb, side = keys[lo].tolist()
                part = b.slice(lo, hi - lo)
                whole = np.frombuffer(b"".join(part.column(5).to_pylist()), dtype=np.int8).reshape(-1, dim)
                own = part.column(4).to_numpy(), whole, part.column(6).to_numpy(), part.column(7).to_numpy()
                if at != (dim, qb, cb):
                    yield from out(cell)
                    at, cell, held = (dim, qb, cb), None, []
                if side == 0:
                    held.append(own)
                    continue
                if cell is None and held:
                    cell = Cell(*[np.concatenate(x) for x in zip(*held)], k)
                    held = []
                if cell is not None:
                    cell.add(*own)
        yield from out(cell)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding", queries: int = QUERIES, candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` that is a query, the ``k`` other rows of largest cosine, ties to
    the smaller key.

    The exact result: a pair is left out only if the bounds of its int8 product say so. Queries and candidates are dealt to
    blocks of bounded size; a cell of the grid meets one block of either, so that no side needs to fit in memory. What
    is dealt to many cells are codes of a byte a component; vectors travel once more, to the pairs that survive. Null
    keys, and vectors that are null, empty, zero, or hold null or non-finite components, take no part. Rows that repeat a
    key are rows like others: a query's own row alone is no candidate, and each such query has its own ranks. Vectors
    of another length are no candidates of a query. Fewer candidates than ``k``: all of them. An empty table gives
    none; other columns are not looked at."""
    v = F.col("e")
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("e"), F.coalesce(is_query, F.lit(False)).alias("q"))
    fit = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    base = cut(base.filter(F.col("id").isNotNull() & F.coalesce(fit, F.lit(False))).withColumn("row", F.monotonically_increasing_id()))
    size = base.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    nq, nc = max(1, -(-size["q"] // queries)), max(1, -(-size["n"] // candidates))
    codes = cut(base.select("row", "e", "q").mapInArrow(_encode, "row long, dim long, q boolean, code binary, scale double, rest double"))
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = ["row", "code", "scale", "rest"]
    ask = codes.filter("q").select("dim", F.pmod(F.xxhash64("row"), F.lit(nq)).alias("qb"), grid(nc).alias("cb"), F.lit(0).cast("long").alias("side"), *own)
    all_ = codes.select("dim", grid(nq).alias("qb"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(nc)).alias("cb"), F.lit(1).cast("long").alias("side"), *own)
    cell = ["dim", "qb", "cb"]
    bounds = ask.union(all_).repartition(*cell).sortWithinPartitions(*cell, "side").mapInArrow(_search(k), "asked long, row long, low double, high double")
    lows = Window.partitionBy("asked").orderBy(F.desc("low"))
    met = bounds.withColumn("nth", F.row_number().over(lows)).withColumn("floor", F.max(F.when(F.col("nth") == k, F.col("low"))).over(Window.partitionBy("asked")))
    pairs = met.filter("floor is null or high >= floor").select("asked", "row")
    squares = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)
    sized = base.withColumn("s", squares(v))
    asked = sized.filter("q").select(F.col("row").alias("asked"), F.col("id").alias("query_id"), F.col("e").alias("qe"), F.col("s").alias("qs"))
    both = pairs.join(sized.select("row", F.col("id").alias("vec_id"), "e", "s"), "row").join(asked, "asked")
    # each sum in double, from the first component to the last
    dot = F.aggregate(F.zip_with("qe", "e", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = both.select("asked", "query_id", "vec_id", (dot / F.sqrt(F.col("qs") * F.col("s"))).alias("score"))
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all ``embeddings`` to each whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


OP4_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r != q.r AND len(c.e) = len(q.e)),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
