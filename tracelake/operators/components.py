"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.storage import cut, sweep


#: Edges up to which one task may hold all of a node, and nodes of very many edges that are sent to all tasks at most.
SMALL, HUBS = 500_000, 50_000


def _with_least(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (a, b; about n) with m, the least b of each a. Nodes with more edges than their share, of which there are
    HUBS at most by this very bound, go to all tasks with their least b: no task joins a hub's edges."""
    low = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    if n <= SMALL:
        return rows.join(low.drop("k"), "a")
    bound = max(1000, n // HUBS)
    hubs = cut(low.filter(F.col("k") > bound).select(F.col("a").alias("hub"), F.col("m").alias("hub_m")))
    met = rows.join(F.broadcast(hubs), F.col("a") == F.col("hub"), "left")
    rest = met.filter("hub is null").select("a", "b").join(low.filter(F.col("k") <= bound).drop("k"), "a")
    return met.filter("hub is not null").select("a", "b", F.col("hub_m").alias("m")).union(rest.select("a", "b", "m"))


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: their number and an order-free hash."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b", rounds: int = 64) -> DataFrame:
    """Returns ``node, root`` for every node of an edge; root is the smallest node of its component.

    Nodes may be of any type that Spark can order. Self-loops and edges with a null end are left out, repeated edges count
    once; an empty table gives an empty result. Every step is an aggregate with partial sums or a join without the hubs
    (see _with_least). Fails after ``rounds`` rounds without a fixed point (each round at least halves the longest path,
    in practice)."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (a.isNull() | b.isNull()).alias("null_end"))
    e = cut(e.filter("not null_end and a != b").select("a", "b").distinct())
    seen = _fingerprint(e)
    for _ in range(rounds if seen[0] else 0):
        n = seen[0]
        both = e.union(e.select("b", "a"))
        # large star: every larger neighbour hangs under the smallest node around, and so does the node itself
        met = _with_least(both, 2 * n).withColumn("m", F.least("a", "m"))
        large = met.select(F.explode(F.array(F.struct(F.greatest("a", "b").alias("a"), "m"), F.struct("a", "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).filter("a > b").distinct()
        large = cut(large) if n > SMALL else large
        # small star: what hangs under several smaller nodes ties these together
        ties = _with_least(large, 2 * n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        e = cut(ties.filter("a > b").distinct())
        now = _fingerprint(e)
        if now == seen:
            break
        seen = now
        if n > SMALL:  # what this round no longer needs would fill the disk
            sweep(e.sparkSession)
    else:
        if seen[0]:
            raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())
