"""Counts and durations over ordered executions: graphs, variants, profiles, windows, histograms, timelines."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.storage import cut, written
from tracelake.model import EngineError, Log
from tracelake.operators.executions import seconds

#: Between activities in a path's text.
ARROW = ">"
PERIODS = ("hour", "day", "week", "month", "quarter", "year")
_STEP = ("activity", "next_activity")


def steps(cases: DataFrame) -> DataFrame:
    """Neighbouring pairs: a row for each event that has a next one, with ``duration`` in seconds."""
    return cases.filter(F.col("next_activity").isNotNull()).withColumn("duration", seconds("next_ts", "ts"))


def dfg(cases: DataFrame, by_type: bool = False) -> DataFrame:
    """source, target[, object_type], frequency."""
    keys = [F.col("activity").alias("source"), F.col("next_activity").alias("target"), *([F.col("object_type")] if by_type else [])]
    return cases.filter(F.col("next_activity").isNotNull()).groupBy(*keys).agg(F.count("*").alias("frequency"))


def dfg_durations(cases: DataFrame) -> DataFrame:
    """source, target, frequency, mean_seconds: the mean is of whole microseconds."""
    us = F.unix_micros("next_ts") - F.unix_micros("ts")
    return cases.filter(F.col("next_activity").isNotNull()).groupBy(F.col("activity").alias("source"), F.col("next_activity").alias("target")).agg(F.count("*").alias("frequency"), (F.sum(us) / F.count("*") / 1e6).alias("mean_seconds"))


def starts(cases: DataFrame) -> DataFrame:
    return cases.filter("pos = 1").groupBy("activity").agg(F.count("*").alias("frequency"))


def ends(cases: DataFrame) -> DataFrame:
    return cases.filter("pos = n").groupBy("activity").agg(F.count("*").alias("frequency"))


def case_summary(cases: DataFrame) -> DataFrame:
    """A row for each execution: object_type, first, last, seconds, events, activities (in order), path, path_hash (first ten
    hex digits of its MD5)."""
    row = F.struct("pos", "activity")
    by = cases.groupBy("execution_id").agg(F.first("object_type").alias("object_type"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("events"), F.transform(F.array_sort(F.collect_list(row)), lambda x: x["activity"]).alias("activities"))
    path = F.array_join("activities", ARROW)
    return by.select("execution_id", "object_type", "first", "last", seconds("last", "first").alias("seconds"), "events", "activities", path.alias("path"), F.substring(F.md5(path), 1, 10).alias("path_hash"))


def variants(cases: DataFrame) -> DataFrame:
    """path, path_hash, frequency."""
    return case_summary(cases).groupBy("path", "path_hash").agg(F.count("*").alias("frequency"))


def variant_stats(cases: DataFrame, top: int | None = 101) -> DataFrame:
    """path_hash, path, frequency and avg/min/max/median/stddev of seconds of the ``top`` variants by frequency, then mean, then hash."""
    s = F.col("seconds")
    by = case_summary(cases).groupBy("path", "path_hash").agg(F.count("*").alias("frequency"), F.avg(s).alias("avg_seconds"), F.min(s).alias("min_seconds"), F.max(s).alias("max_seconds"), F.median(s).alias("median_seconds"), F.stddev_samp(s).alias("stddev_seconds"))
    return by if top is None else by.orderBy(F.desc("frequency"), F.round("avg_seconds", 6), "path_hash").limit(top)


def activity_profile(cases: DataFrame) -> DataFrame:
    """activity, cases (distinct), occurrences, starts, ends. Cases are counted by their first occurrence: no distinct is needed."""
    first = F.row_number().over(Window.partitionBy("execution_id", "activity").orderBy("pos")) == 1
    return cases.withColumn("_first", first).groupBy("activity").agg(F.count_if("_first").alias("cases"), F.count("*").alias("occurrences"), F.count_if(F.col("pos") == 1).alias("starts"), F.count_if(F.col("pos") == F.col("n")).alias("ends"))


def contained(cases: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Executions that lie wholly in [start, end)."""
    whole = Window.partitionBy("execution_id")
    out = cases
    if start is not None:
        out = out.withColumn("_a", F.min("ts").over(whole)).filter(F.col("_a") >= F.lit(start)).drop("_a")
    if end is not None:
        out = out.withColumn("_z", F.max("ts").over(whole)).filter(F.col("_z") < F.lit(end)).drop("_z")
    return out


def clipped(cases: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Executions wholly inside the window, and the parts inside of those that reach over its borders."""
    return cases.filter((F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end)))


def summary(cases: DataFrame) -> dict[str, DataFrame]:
    """All counts of one ordered relation: totals, dfg, variants, activities. Persist ``cases`` to sort it once."""
    totals = cases.agg(F.count_if(F.col("pos") == 1).alias("cases"), F.count("*").alias("events"))
    return {"totals": totals, "dfg": dfg_durations(cases), "variants": variants(cases), "activities": activity_profile(cases)}


def multi_window(cases: DataFrame, windows: list[tuple[datetime, datetime]], keys: Iterable[str] = _STEP, least: int = 0) -> DataFrame:
    """keys, counts: for each key its number of steps in every window (both events inside), zeros filled in, and only then
    the threshold: some window reaches ``least``. One pass, however many windows."""
    inside = lambda a, z: (F.col("ts") >= F.lit(a)) & (F.col("next_ts") < F.lit(z))
    out = steps(cases).groupBy(*keys).agg(F.array(*[F.count_if(inside(a, z)) for a, z in windows]).alias("counts"))
    return out.filter(F.array_max("counts") >= max(least, 1))


def variant_windows(cases: DataFrame, windows: list[tuple[datetime, datetime]], including: Iterable[str] = (), excluding: Iterable[str] = (), hashes: Iterable[str] = ()) -> DataFrame:
    """path_hash, path, counts: cases wholly in each window, of variants with all of ``including``, none of ``excluding``."""
    s = case_summary(cases)
    if including:
        s = s.filter(F.size(F.array_except(F.array(*map(F.lit, including)), "activities")) == 0)
    if excluding:
        s = s.filter(~F.arrays_overlap("activities", F.array(*map(F.lit, excluding))))
    if hashes:
        s = s.filter(F.col("path_hash").isin(list(hashes)))
    return s.groupBy("path_hash", "path").agg(F.array(*[F.count_if((F.col("first") >= F.lit(a)) & (F.col("last") < F.lit(z))) for a, z in windows]).alias("counts")).filter(F.array_max("counts") > 0)


def edge_features(cases: DataFrame, slow: float) -> DataFrame:
    """source, target, frequency, mean, min, max, stddev (sample) of seconds, slow_count (over ``slow``) and slow_rate."""
    d = F.col("duration")
    by = steps(cases).groupBy(F.col("activity").alias("source"), F.col("next_activity").alias("target"))
    return by.agg(F.count("*").alias("frequency"), F.avg(d).alias("mean_seconds"), F.min(d).alias("min_seconds"), F.max(d).alias("max_seconds"), F.stddev_samp(d).alias("stddev_seconds"), F.count_if(d > slow).alias("slow_count"), F.avg((d > slow).cast("double")).alias("slow_rate"))


def rework(cases: DataFrame) -> DataFrame:
    """source, target, cases, repeats: steps that a case makes again."""
    by = steps(cases).groupBy("execution_id", "activity", "next_activity").agg(F.count("*").alias("n")).filter("n > 1")
    return by.groupBy(F.col("activity").alias("source"), F.col("next_activity").alias("target")).agg(F.count("*").alias("cases"), F.sum(F.col("n") - 1).alias("repeats"))


def duration_series(cases: DataFrame, period: str = "month") -> DataFrame:
    """bucket, source, target, frequency, mean_seconds by the time of the step's second event; empty buckets are absent."""
    if period not in PERIODS:
        raise EngineError("invalid_request", f"no such period: {period}")
    return steps(cases).groupBy(F.date_trunc(period, "next_ts").alias("bucket"), F.col("activity").alias("source"), F.col("next_activity").alias("target")).agg(F.count("*").alias("frequency"), F.avg("duration").alias("mean_seconds"))


def top_variant(summaries: DataFrame) -> DataFrame:
    """Executions of the most frequent variant (ties: smallest hash): one row joined back, no sort of the cases. Summaries are
    written, as they are read twice."""
    summaries = written(summaries)
    top = summaries.groupBy("path_hash").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "path_hash").limit(1).select("path_hash")
    return summaries.join(F.broadcast(top), "path_hash", "left_semi")


def timeline(cases: DataFrame, period: str, only_top: bool = True) -> DataFrame:
    """bucket, cases: executions by the period they begin in; of the top variant only, as the endpoint of that name does."""
    if period not in PERIODS:
        raise EngineError("invalid_request", f"no such period: {period}")
    s = case_summary(cases)
    return (top_variant(s) if only_top else s).groupBy(F.date_trunc(period, "first").alias("bucket")).agg(F.count("*").alias("cases"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (1 to bins; the largest value gets bins), count, min, max, mean. All values equal: one bin, the first."""
    values = cut(values.select(column))  # read twice: the executions behind it are not
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    v = F.col(column)
    if lo is None or lo == hi:
        b: Column = F.lit(1)
    else:
        b = F.least(F.floor((v - F.lit(lo)) / F.lit((hi - lo) / bins)) + 1, F.lit(bins))
    return values.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))


def throughput_histogram(cases: DataFrame, bins: int = 19) -> DataFrame:
    """Histogram of seconds of the top variant's executions."""
    return histogram(top_variant(case_summary(cases)), "seconds", bins)


def edge_histogram(cases: DataFrame, source: str, target: str, bins: int = 19, only_top: bool = True) -> DataFrame:
    """Histogram of one edge's durations, with the share of all its steps; of executions of the top variant only by default."""
    s = steps(cases).filter((F.col("activity") == source) & (F.col("next_activity") == target))
    if only_top:
        s = s.join(top_variant(case_summary(cases)).select("execution_id"), "execution_id", "left_semi")
    h = histogram(s, "duration", bins)
    total = s.count()
    return h.withColumn("percent", F.col("count") * 100.0 / max(1, total))


def process_map(cases: DataFrame, period: str = "week") -> dict[str, DataFrame]:
    """nodes (targets and pure sources), edges and timeline."""
    e = dfg_durations(cases)
    into = e.groupBy(F.col("target").alias("activity")).agg(F.sum("frequency").alias("frequency"))
    pure = e.select(F.col("source").alias("activity"), "frequency").join(into, "activity", "left_anti").groupBy("activity").agg(F.sum("frequency").alias("frequency"))
    return {"nodes": into.union(pure), "edges": e, "timeline": timeline(cases, period, only_top=False)}


def map_by(cases: DataFrame, attribute: str) -> DataFrame:
    """activity, value, frequency: nodes of the map by an event attribute (its text)."""
    from tracelake.model import text_of

    return cases.groupBy("activity", text_of(F.try_element_at("attributes", F.lit(attribute))).alias("value")).agg(F.count("*").alias("frequency"))


def case_page(cases: DataFrame, limit: int, offset: int = 0, only_top: bool = True, log: Log | None = None) -> DataFrame:
    """A page of executions (1 to 1000), longest first, with activities and edges, and with ``log`` the objects (id, type) that
    share an event with the execution's object."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise EngineError("invalid_request", "limit is 1 to 1000, offset not negative")
    s = case_summary(cases)
    s = top_variant(s) if only_top else s
    page = s.orderBy(F.desc("seconds"), "execution_id").offset(offset).limit(limit)
    edges = steps(cases).join(F.broadcast(page.select("execution_id")), "execution_id", "left_semi").groupBy("execution_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "activity", "next_activity", "duration"))), lambda x: F.struct(x["activity"].alias("source"), x["next_activity"].alias("target"), x["duration"].alias("seconds"))).alias("edges"))
    page = page.join(edges, "execution_id", "left")
    if log is None:
        return page
    own = cases.join(F.broadcast(page.select("execution_id")), "execution_id", "left_semi").select("execution_id", "event_id")
    met = own.join(log.e2o.select("event_id", "object_id"), "event_id").join(log.objects, "object_id")
    objects = met.groupBy("execution_id").agg(F.array_sort(F.collect_set(F.struct("object_id", "object_type"))).alias("objects"))
    return page.join(objects, "execution_id", "left")


def dynamic_filter(cases: DataFrame, *, statuses=(), including=(), excluding=(), min_seconds=None, max_seconds=None, attributes_in: dict | None = None, attributes_out: dict | None = None,
                   edges_in: Iterable[dict] = (), edges_out: Iterable[dict] = (), related: DataFrame | None = None, related_in: Iterable[str] = (), related_out: Iterable[str] = ()) -> DataFrame:
    """execution_id of cases that fit: any status, all activities of ``including`` and none of ``excluding``, a duration range,
    string attributes that some event has or no event has, edges {source, target, min, max} that occur or do not, and types
    of related objects (``related``: execution_id, object_type), all of which or none of which it has.

    All parts but the last are aggregates over one grouping, so the number of filters adds no shuffle."""
    attribute = lambda k: F.try_element_at("attributes", F.lit(k))["s"]
    sums: dict[str, Column] = {"first": F.min("ts"), "last": F.max("ts")}
    tests: list[Column] = []

    def need(column: Column, wanted: bool = True) -> None:
        name = f"t{len(sums)}"
        sums[name] = F.coalesce(F.bool_or(column), F.lit(False))
        tests.append(F.col(name) if wanted else ~F.col(name))

    if statuses:
        need(attribute("status").isin(list(statuses)))
    for a in including:
        need(F.col("activity") == a)
    for a in excluding:
        need(F.col("activity") == a, False)
    for k, v in (attributes_in or {}).items():
        need(attribute(k).isin(list(v)))
    for k, v in (attributes_out or {}).items():
        need(attribute(k).isin(list(v)), False)
    for wanted, edges in ((True, edges_in), (False, edges_out)):
        for e in edges:
            hit = (F.col("activity") == e["source"]) & (F.col("next_activity") == e["target"])
            d = seconds("next_ts", "ts")
            if e.get("min") is not None:
                hit = hit & (d >= e["min"])
            if e.get("max") is not None:
                hit = hit & (d <= e["max"])
            need(hit, wanted)
    if min_seconds is not None:
        tests.append(seconds("last", "first") >= min_seconds)
    if max_seconds is not None:
        tests.append(seconds("last", "first") <= max_seconds)
    out = cases.groupBy("execution_id").agg(*[c.alias(n) for n, c in sums.items()])
    for t in tests:
        out = out.filter(t)
    wanted, unwanted = list(dict.fromkeys(related_in)), list(related_out)
    if wanted or unwanted:
        if related is None:
            raise EngineError("invalid_request", "filters of related types need the related objects")
        has = lambda ts: F.count_distinct(F.when(F.col("object_type").isin(ts), F.col("object_type"))) if ts else F.lit(0)
        by = related.groupBy("execution_id").agg(has(wanted).alias("_in"), has(unwanted).alias("_out"))
        out = out.join(by, "execution_id", "left").filter((F.coalesce("_in", F.lit(0)) == len(wanted)) & (F.coalesce("_out", F.lit(0)) == 0))
    return out.select("execution_id")


def dynamic_dfg(cases: DataFrame, **filters) -> DataFrame:
    """The graph of the cases that fit, ranked by mean duration, frequency, then names."""
    kept = cases.join(dynamic_filter(cases, **filters), "execution_id", "left_semi")
    rank = F.row_number().over(Window.orderBy(F.desc("mean_seconds"), F.desc("frequency"), "source", "target"))  # a row for each edge
    return dfg_durations(kept).withColumn("rank", rank)
