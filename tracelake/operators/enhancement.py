"""Enhancement: maps, timelines, histograms, performance, rework, organisation, comparison of windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.model import EngineError
from tracelake.operators import kernels, stats
from tracelake.operators.executions import ORDER, seconds

#: Lifecycle transitions that begin and end work.
BEGIN, FINISH = ("start", "begin", "resume"), ("complete", "end", "suspend")


def process_map(cases: DataFrame) -> dict[str, DataFrame]:
    return {"nodes": stats.activity_profile(cases), "edges": stats.dfg_durations(cases)}


def dotted_chart(cases: DataFrame) -> DataFrame:
    """A dot for each event of an execution: execution_id, activity, ts, seconds since the execution's first event."""
    first = F.min("ts").over(Window.partitionBy("execution_id"))
    return cases.select("execution_id", "event_id", "activity", "ts", seconds("ts", first).alias("offset"))


def cycle_histogram(cases: DataFrame, bins: int = 10) -> DataFrame:
    return stats.histogram(stats.case_summary(cases), "seconds", bins)


def fifo_pairs(points: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Starts and completes of ``points`` (column way: 1 or -1; ts; event_id; any others) paired first in, first out by ``keys``:
    the rows of starts with columns c_* of their completes.

    No loop: with S the running sum of ways and M its running minimum (0 at most), a complete found the queue empty iff it
    lowered M; the k-th of the others belongs to the k-th start. Pairs that end before they begin go."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    p = points.withColumn("_s", F.sum("way").over(w))
    p = p.withColumn("_m", F.least(F.lit(0), F.min("_s").over(w)))
    p = p.withColumn("_b", F.coalesce(F.lag("_m").over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0)))
    p = p.filter((F.col("way") == 1) | (F.col("_m") == F.col("_b")))
    p = p.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "way").orderBy(*order))).drop("_s", "_m", "_b")
    rest = [c for c in points.columns if c not in keys and c != "way"]
    done = p.filter("way = -1").select(*keys, "_k", *[F.col(c).alias(f"c_{c}") for c in rest])
    return p.filter("way = 1").join(done, [*keys, "_k"]).filter("c_ts >= ts").drop("_k", "way")


def performance(members: DataFrame) -> DataFrame:
    """metric, support, mean, minimum, maximum, median (seconds) of:

    directly_follows (neighbouring events of an execution), cycle (its first to its last event), service (start to complete of
    an activity, paired first in, first out), waiting and sojourn (from the execution's completion before that one to the
    start, and to the complete; a start before that completion has no waiting), and of the objects of an event that the
    execution has met before: flow (each, from its event before), pooling (from the latest of these), lagging (from the
    earliest), synchronization (the earliest to the latest, of several).

    ``members`` has a row for each execution, event and object of it. Lifecycles are start and complete, in any case."""
    cases = members.dropDuplicates(["execution_id", "event_id"])
    case = Window.partitionBy("execution_id").orderBy(*ORDER)
    life = F.lower("lifecycle")
    done = F.last(F.when(life == "complete", F.col("ts")), ignorenulls=True).over(case.rowsBetween(Window.unboundedPreceding, -1))
    walk = cases.select("execution_id", "event_id", "activity", "ts", life.alias("life"), F.lag("ts").over(case).alias("before"), F.row_number().over(case).alias("pos"), done.alias("done"))
    way = F.when(F.col("life") == "start", 1).when(F.col("life") == "complete", -1)
    pairs = fifo_pairs(walk.select("execution_id", "activity", "pos", "ts", "event_id", "done", way.alias("way")).filter("way is not null"), ["execution_id", "activity"], ["pos"])
    named = lambda df, name, v: df.select(F.lit(name).alias("metric"), v.alias("v"))
    cycle = cases.groupBy("execution_id").agg(seconds(F.max("ts"), F.min("ts")).alias("s"))
    met = members.withColumn("ready", F.lag("ts").over(Window.partitionBy("execution_id", "object_id").orderBy(*ORDER))).filter("ready is not null")
    joint = met.groupBy("execution_id", "event_id").agg(F.first("ts").alias("ts"), F.min("ready").alias("lo"), F.max("ready").alias("hi"), F.count("*").alias("k"))
    parts = [
        named(walk.filter("before is not null"), "directly_follows", seconds("ts", "before")), named(cycle, "cycle", F.col("s")), named(pairs, "service", seconds("c_ts", "ts")),
        named(pairs.filter("c_done <= ts"), "waiting", seconds("ts", "c_done")), named(pairs.filter("c_done is not null"), "sojourn", seconds("c_ts", "c_done")), named(met, "flow", seconds("ts", "ready")),
        named(joint, "pooling", seconds("ts", "hi")), named(joint, "lagging", seconds("ts", "lo")), named(joint.filter("k > 1"), "synchronization", seconds("hi", "lo")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    v = F.col("v")
    return out.groupBy("metric").agg(F.count("*").alias("support"), F.avg(v).alias("mean"), F.min(v).alias("minimum"), F.max(v).alias("maximum"), F.percentile(v, 0.5).alias("median"))


def ranked_edges(cases: DataFrame) -> DataFrame:
    return stats.dfg_durations(cases).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_seconds"), F.desc("frequency"), "source", "target")))


def rework(cases: DataFrame) -> DataFrame:
    """activity, cases, repeats: the sum over executions of occurrences beyond the first."""
    by = cases.groupBy("execution_id", "activity").agg(F.count("*").alias("n")).filter("n > 1")
    return by.groupBy("activity").agg(F.count("*").alias("cases"), F.sum(F.col("n") - 1).alias("repeats"))


def organisation(cases: DataFrame, attribute: str = "resource") -> dict[str, DataFrame]:
    """workload, by_activity, executions (of each resource) and handovers; events without the resource are stepped over."""
    r = cases.withColumn("resource", F.try_element_at("attributes", F.lit(attribute))["s"]).filter("resource is not null").select("execution_id", "activity", "resource", *ORDER)
    nxt = F.lead("resource").over(Window.partitionBy("execution_id").orderBy(*ORDER))
    hand = r.withColumn("target", nxt).filter("target is not null").groupBy(F.col("resource").alias("source"), "target").agg(F.count("*").alias("frequency"))
    return {
        "workload": r.groupBy("resource").agg(F.count("*").alias("events")),
        "by_activity": r.groupBy("resource", "activity").agg(F.count("*").alias("events")),
        "executions": r.groupBy("resource").agg(F.count_distinct("execution_id").alias("executions")),
        "handovers": hand,
    }


def compare(baseline: DataFrame, current: DataFrame, by: str = "dfg") -> dict[str, DataFrame]:
    """Divergence of two populations over activities, graph or variants, its terms, and the change of the mean cycle time. If
    one side is empty the divergence is 0.5."""
    keys = {"activity": ["activity"], "dfg": ["activity", "next_activity"], "variant": ["path"]}
    if by not in keys:
        raise EngineError("invalid_request", f"compare by {sorted(keys)}")

    def counts(cases: DataFrame, name: str) -> DataFrame:
        rows = stats.case_summary(cases) if by == "variant" else cases.filter("next_activity is not null") if by == "dfg" else cases
        return rows.groupBy(F.concat_ws(stats.ARROW, *keys[by]).alias("label")).agg(F.count("*").alias(name))

    both = counts(baseline, "baseline").select("label", "baseline", F.lit(0).cast("long").alias("current")).union(counts(current, "current").select("label", F.lit(0).cast("long"), "current"))
    total, top = kernels.frequency_drift(both, "label", top=1 << 30, empty=0.5)
    mean = lambda c: stats.case_summary(c).agg(F.avg("seconds"))
    cycle = mean(baseline).toDF("baseline").join(mean(current).toDF("current"), how="cross")  # one number each
    return {"divergence": total, "terms": top, "cycle": cycle.withColumn("change", F.col("current") - F.col("baseline"))}
