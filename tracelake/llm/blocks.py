"""Pigeonhole block joins of 64-bit fingerprints, exact for groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.storage import cut
from tracelake.llm.common import tidied

#: Rows of a bucket that one tile holds; a task compares two tiles at most, so its memory does not grow with a bucket.
TILE = 8192
#: Bytes of rows that are compared in one sweep.
AT_ONCE = 4 << 20


def masks(n_blocks: int, distance: int) -> list[int]:
    """Bit masks of which at least one shows two fingerprints as equal if they differ in ``distance`` bits or fewer:
    ``distance`` differing bits touch that many of ``n_blocks`` blocks at most, so some choice of the others is intact."""
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    out = [sum(c) for c in combinations(blocks, n_blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def block_count(n: int, distance: int, chance: int = 512) -> int:
    """The fewest blocks with which a bucket holds at most about ``chance`` fingerprints that only chance put there: comparing
    these (some 10 ns a pair) costs less than dealing every row to more buckets (some µs a row). Only the cost depends
    on it, never the result."""
    for blocks in range(distance + 1, distance + 6):
        if n <= chance << (64 * (blocks - distance) // blocks):
            return blocks
    return distance + 5


def tiles(rows: DataFrame, n: int, distance: int, tile: int = TILE, buckets: str | None = None, weight: str | None = None) -> tuple[DataFrame, list[int]]:
    """Deals ``rows`` (column fp; more may follow) into buckets by block key and cuts buckets of over ``tile`` rows into
    tiles: columns mask, key, i, j before those of rows. Two rows of one bucket meet in some (i, j). Also the masks.
    ``buckets`` names a column of rows, an array of longs: these are the keys then, and there are no masks. ``weight``
    names a column of what a row counts against ``tile`` (by default 1)."""
    choice = masks(block_count(n, distance), distance) if buckets is None else []
    kept = [c for c in rows.columns if c != buckets]
    if buckets is None:
        keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in choice])).alias("mask", "key")
    else:
        rows = rows.select(F.lit(0).alias("mask"), F.explode(buckets).alias("key"), *kept)
    keyed = rows.select(keys, *kept) if buckets is None else rows
    size = F.count("*") if weight is None else F.sum(weight)
    large = cut(keyed.groupBy("mask", "key").agg(size.cast("long").alias("size")).filter(F.col("size") > tile))
    count = large.count()
    large = large.union(large.sparkSession.range(1).select(F.lit(-1).alias("mask"), F.lit(0).cast("long").alias("key"), F.lit(1).cast("long").alias("size")))  # the same plan, with large buckets or without
    # the large buckets: few rows, and sent to all tasks only if this count says so
    met = keyed.join(F.broadcast(large) if count <= 20_000 else large, ["mask", "key"], "left")
    parts = F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("int")
    met = met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "parts").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.select("mask", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *kept), choice


def _roots(lab: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = lab[i]
    while True:
        up = lab[r]
        if (up == r).all():
            return r
        r = up


def _union(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Ties i[k] to j[k]: larger roots go under smaller ones. lab[x] is x or a smaller row of the same part."""
    while len(i):
        a, b = _roots(lab, i), _roots(lab, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))


def linker(distance: int, choice: list[int], node: str, out: pa.Schema, verify: Callable | None = None, payload: str | None = None, near: tuple[list[str], Callable] | None = None):
    """A function for mapInArrow over sorted tiles. It compares all pairs of a tile group, a diagonal at a time, and emits
    a spanning forest (a, b) of each group's links. ``verify(x, y)`` has the last word on a pair, from its payloads. It is
    asked only where a pair meets under the first mask that brings it together, and not for pairs that are already tied."""
    unsigned = [np.uint64(m & (1 << 64) - 1) for m in choice]

    def forest(t: pa.Table) -> pa.RecordBatch:
        fp = t["fp"].to_numpy().view(np.uint64)  # bitwise_count takes the absolute value of what has a sign
        group = np.zeros(len(fp), dtype=np.int64)
        for c in ("mask", "key", "i", "j"):
            v = t[c].to_numpy()
            group[1:] |= v[1:] != v[:-1]
        start = np.flatnonzero(np.concatenate([[True], group[1:] != 0]))
        pos = np.arange(len(fp)) - np.repeat(start, np.diff(np.append(start, len(fp))))
        words, mask = t[payload].to_pylist() if payload else None, t["mask"].to_numpy()
        seen = [t[c].to_numpy() for c in near[0]] if near else []
        lab, ties = np.arange(len(fp)), []
        # a row of tile i and one of tile j, i < j, or two of one tile: two of one tile met in (i, i) already, but a second look costs no more than the test for it
        live = np.flatnonzero(pos >= 1)
        off = 1
        while len(live):
            hit = live[np.bitwise_count(fp[live] ^ fp[live - off]) <= distance]
            if near and len(hit):
                hit = hit[near[1](*[v[hit] for v in seen], *[v[hit - off] for v in seen])]
            if verify is None:
                _union(lab, hit - off, hit)
            elif len(hit):
                hit = hit[_roots(lab, hit) != _roots(lab, hit - off)]
                apart, own = fp[hit] ^ fp[hit - off], mask[hit]
                for k, m in enumerate(unsigned[:-1]):
                    earlier = (own > k) & (apart & m == 0)
                    hit, apart, own = hit[~earlier], apart[~earlier], own[~earlier]
                for x in hit.tolist():
                    ends = np.array([x - off, x])
                    a, b = _roots(lab, ends)
                    if a != b and verify(words[x], words[x - off]):
                        lab[max(a, b)] = min(a, b)
            off += 1
            live = live[pos[live] >= off]
        lab = _roots(lab, np.arange(len(fp)))
        tied = np.flatnonzero(lab != np.arange(len(fp)))
        ids = t[node]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(tied)).combine_chunks(), ids.take(pa.array(lab[tied])).combine_chunks()], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting, size = [], 0
        for b in batches:
            waiting.append(b)
            size += b.nbytes
            if size < AT_ONCE:
                continue
            t = pa.Table.from_batches(waiting)
            held = pa.concat_tables([held, t]) if held is not None else t
            waiting, size = [], 0
            last = {c: held[c][-1].as_py() for c in ("mask", "key", "i", "j")}
            same = np.ones(held.num_rows, dtype=bool)
            for c, v in last.items():
                same &= held[c].to_numpy() == v
            first = int(np.flatnonzero(same)[0])
            if first:
                yield forest(held.slice(0, first).combine_chunks())
                held = held.slice(first)
        if waiting:
            t = pa.Table.from_batches(waiting)
            held = pa.concat_tables([held, t]) if held is not None else t
        if held is not None and held.num_rows:
            yield forest(held.combine_chunks())

    return tidied(run)


def links(rows: DataFrame, n: int, distance: int, node: str = "fp", tile: int = TILE, verify: Callable | None = None, payload: str | None = None, buckets: str | None = None, near: tuple[list[str], Callable] | None = None, weight: str | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose fingerprints differ in ``distance`` bits or fewer (and that ``verify`` accepts).
    With ``buckets`` (see tiles) only those that share a key. ``near``: columns and a function of their values at both ends,
    as arrays, that says which pairs may be tied at all. ``weight``: see tiles.

    Not all of them: in each tile group a spanning forest, which has the same connected components. ``rows`` has a row for
    each node, columns fp (long), node and payload. n: their number, or about."""
    dealt, choice = tiles(rows, n, distance, tile, buckets, weight)
    order = ["mask", "key", "i", "j"]
    kind = dict(rows.dtypes)[node]
    arrow = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[kind]
    out = pa.schema([("a", arrow), ("b", arrow)])
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(linker(distance, choice, node, out, verify, payload, near), f"a {kind}, b {kind}")
