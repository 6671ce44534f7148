"""Registered queries of the process engine over the demo logs, and the SQL that states the same."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.engine import closure
from tracelake.functions.storage import cut, shared_dir, written
from tracelake.model import Log, View, canonical_json, validate
from tracelake.operators import bottlenecks, conformance, constraints, discovery, enhancement, executions, kernels, prediction, risk, stats
from tracelake.sources import demo, readers, writers
from tracelake.streaming.append import Summary, append

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(log: Callable[[SparkSession, str], Log], sql: str | None = None, prefix: str | None = None):
    """Registers ``f(log)`` under its name. sql: the body behind the CTEs of the log."""

    def add(f: Callable[[Log], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(log(spark, sf_dir))
        if sql is not None:
            base = prefix if prefix is not None else demo.USERS_SQL if log is demo.users else demo.ORDERS_SQL
            SQL[name] = f"WITH {base.strip()}{sql}" if sql.lstrip().startswith(",") else f"WITH {base.strip()}\n{sql}"
        return f

    return add


A, B = demo.users, demo.orders


def _t(day: int, hour: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, tzinfo=timezone.utc)


def _cases(log: Log, **view) -> DataFrame:
    return executions.ordered(executions.leading(log, View(**view), attributes=bool(view.get("event_attributes") or view.get("statuses"))))


def _full(log: Log, **view) -> DataFrame:
    return executions.ordered(executions.leading(log, View(**view)))


def _twice(cases: DataFrame) -> DataFrame:
    """``cases`` for a query that reads them twice: what paths and graphs are made of, as a table."""
    return written(cases.select("execution_id", "object_type", "activity", "ts", "pos", "n", "next_activity", "next_ts"))


def _rounded(df: DataFrame, *names: str, digits: int = 3) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _d(a: str = "nxt_ts", b: str = "ts") -> str:
    return f"((epoch_us({a}) - epoch_us({b})) / 1e6)"


# --- model and profile ---


@query(A, """SELECT (SELECT count(*) FROM u) AS events, (SELECT count(DISTINCT activity) FROM u) AS activities, CAST((SELECT epoch_us(min(ts)) FROM u) AS BIGINT) AS first_us,
CAST((SELECT epoch_us(max(ts)) FROM u) AS BIGINT) AS last_us, (SELECT count(DISTINCT object_id) FROM u) AS objects, CAST(1 AS BIGINT) AS object_types, (SELECT count(*) FROM u) AS e2o, CAST(0 AS BIGINT) AS o2o""")  # fmt: skip
def profile_counts(log):
    p = executions.profile(log)
    return p.select("events", "activities", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "objects", "object_types", "e2o", "o2o")


@query(B, "SELECT object_type, count(*) AS objects FROM ob GROUP BY 1")
def object_type_histogram(log):
    return log.objects.groupBy("object_type").agg(F.count("*").alias("objects"))


@query(A, "SELECT activity, count(*) AS events FROM u GROUP BY 1")
def activity_histogram(log):
    return log.events.groupBy("activity").agg(F.count("*").alias("events"))


_COUNTS = {
    "event_text_empty": "ev WHERE activity = ''", "object_text_empty": "ob WHERE object_type = ''", "event_id_repeated": "(SELECT event_id FROM ev GROUP BY 1 HAVING count(*) > 1)",
    "external_event_id_repeated": "(SELECT 'e' || lpad(CAST(event_id AS VARCHAR), 18, '0') FROM ev GROUP BY 1 HAVING count(*) > 1)", "object_id_repeated": "(SELECT object_id FROM ob GROUP BY 1 HAVING count(*) > 1)",
    "e2o_relation_repeated": "(SELECT event_id, qualifier FROM eo GROUP BY 1, 2 HAVING count(*) > 1)", "o2o_relation_repeated": "(SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)",
    "e2o_event_missing": "eo ANTI JOIN ev USING (event_id)", "e2o_object_missing": "eo ANTI JOIN ob USING (object_id)", "o2o_source_missing": "(SELECT o_orderkey * 4 AS object_id FROM orders) ANTI JOIN ob USING (object_id)",
    "o2o_target_missing": "(SELECT o_custkey * 4 + 1 AS object_id FROM orders) ANTI JOIN ob USING (object_id)", "o2o_interval_empty": "orders WHERE NULL <= o_orderdate", "attribute_object_missing": "(SELECT o_orderkey * 4 AS object_id FROM orders) ANTI JOIN ob USING (object_id)",
    "attribute_change_repeated": "(SELECT o, n, t FROM (SELECT o_orderkey AS o, unnest(['priority', 'status', 'status']) AS n, unnest([o_orderdate, o_orderdate, o_orderdate + INTERVAL 7 DAY]) AS t FROM orders) GROUP BY ALL HAVING count(*) > 1)",
}


@query(B, " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS violations FROM {v}" for k, v in _COUNTS.items()))
def validation(log):
    return validate(log)


@query(B, """SELECT count(*) FILTER (activity IN ('place', 'ship')) AS events, (SELECT count(*) FROM ob WHERE object_type = 'order') AS objects FROM ev
WHERE event_id IN (SELECT event_id FROM eo JOIN ob USING (object_id) WHERE object_type = 'order')""")
def profile_by_view(log):
    p = executions.profile(log, View(object_types=("order",), activities=("place", "ship")))
    return p.select("events", "objects")


@query(B, """, k AS (SELECT object_id FROM ob WHERE object_type IN ('order', 'customer')), e AS (SELECT * FROM eo WHERE object_id IN (SELECT object_id FROM k))
SELECT (SELECT count(DISTINCT event_id) FROM e) AS events, (SELECT count(*) FROM k) AS objects, (SELECT count(*) FROM e) AS e2o, (SELECT count(*) FROM orders) AS o2o""")
def snapshot_counts(log):
    s = executions.snapshot(log, View(object_types=("order", "customer")))
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(s.events, "events").join(one(s.objects, "objects"), how="cross").join(one(s.e2o, "e2o"), how="cross").join(one(s.o2o, "o2o"), how="cross")


# --- graphs, variants, profiles ---


@query(A, "SELECT activity AS source, nxt AS target, count(*) AS frequency FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2")
def dfg(log):
    return stats.dfg(_cases(log))


@query(B, "SELECT activity AS source, nxt AS target, object_type, count(*) AS frequency FROM y WHERE nxt IS NOT NULL GROUP BY 1, 2, 3")
def oc_dfg(log):
    return stats.dfg(_cases(log), by_type=True)


@query(A, f"SELECT activity AS source, nxt AS target, count(*) AS frequency, round(sum(epoch_us(nxt_ts) - epoch_us(ts)) / count(*) / 1e6, 3) AS mean_seconds FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2")
def dfg_durations(log):
    return stats.dfg_durations(_cases(log)).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query(A, "SELECT activity, count(*) AS frequency FROM x WHERE pos = 1 GROUP BY 1")
def start_activities(log):
    return stats.starts(_cases(log))


@query(A, "SELECT activity, count(*) AS frequency FROM x WHERE pos = n GROUP BY 1")
def end_activities(log):
    return stats.ends(_cases(log))


_PATHS = ", v AS (SELECT object_id, object_type, string_agg(activity, '>' ORDER BY pos) AS path, min(ts) AS first, max(ts) AS last, count(*) AS events FROM y GROUP BY 1, 2)"
_UPATHS = ", v AS (SELECT object_id, string_agg(activity, '>' ORDER BY pos) AS path, min(ts) AS first, max(ts) AS last, count(*) AS events FROM x GROUP BY 1)"


@query(B, f"{_PATHS} SELECT path, substr(md5(path), 1, 10) AS path_hash, count(*) AS frequency FROM v WHERE object_type = 'order' GROUP BY 1")
def variants(log):
    return stats.variants(_cases(log, object_types=("order",)))


@query(B, f"""{_PATHS}, s AS (SELECT path, count(*) AS frequency, avg({_d('last', 'first')}) AS a, min({_d('last', 'first')}) AS lo, max({_d('last', 'first')}) AS hi, median({_d('last', 'first')}) AS med
FROM v WHERE object_type = 'order' GROUP BY 1)
SELECT path, substr(md5(path), 1, 10) AS path_hash, frequency, round(a, 3) AS avg_seconds, lo AS min_seconds, hi AS max_seconds, round(med, 3) AS median_seconds FROM s ORDER BY frequency DESC, round(a, 6), path_hash LIMIT 101""")
def variant_stats(log):
    v = stats.variant_stats(_cases(log, object_types=("order",)))
    return v.select("path", "path_hash", "frequency", F.round("avg_seconds", 3).alias("avg_seconds"), "min_seconds", "max_seconds", F.round("median_seconds", 3).alias("median_seconds"))


@query(A, "SELECT activity, count(DISTINCT object_id) AS cases, count(*) AS occurrences, count(*) FILTER (pos = 1) AS starts, count(*) FILTER (pos = n) AS ends FROM x GROUP BY 1")
def activity_profile(log):
    return stats.activity_profile(_cases(log))


@query(B, f"""{_PATHS} SELECT execution_id, path_hash, events, seconds FROM (SELECT object_id AS execution_id, substr(md5(path), 1, 10) AS path_hash, events, {_d('last', 'first')} AS seconds FROM v WHERE object_type = 'supplier')""")
def case_summary(log):
    return stats.case_summary(_cases(log, object_types=("supplier",))).select("execution_id", "path_hash", "events", "seconds")


@query(A, """, w AS (SELECT *, min(ts) OVER (PARTITION BY object_id) AS a, max(ts) OVER (PARTITION BY object_id) AS z FROM x)
SELECT activity, count(DISTINCT object_id) AS cases, count(*) AS occurrences FROM w WHERE a >= TIMESTAMP '2024-01-01' AND z < TIMESTAMP '2024-01-30 12:00:00' GROUP BY 1""")
def execution_summary_contained(log):
    return stats.activity_profile(stats.contained(_cases(log), _t(1), _t(30, 12))).select("activity", "cases", "occurrences")


@query(A, """SELECT activity, next_activity, w1, w2, w3 FROM (SELECT activity, nxt AS next_activity, count(*) FILTER (ts >= TIMESTAMP '2024-01-01' AND nxt_ts < TIMESTAMP '2024-01-10') AS w1,
count(*) FILTER (ts >= TIMESTAMP '2024-01-10' AND nxt_ts < TIMESTAMP '2024-01-20') AS w2, count(*) FILTER (ts >= TIMESTAMP '2024-01-20' AND nxt_ts < TIMESTAMP '2024-01-31') AS w3
FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2) WHERE greatest(w1, w2, w3) >= 20""")  # fmt: skip
def multi_window_dfg(log):
    m = stats.multi_window(_cases(log), [(_t(1), _t(10)), (_t(10), _t(20)), (_t(20), _t(31))], least=20)
    return m.select("activity", "next_activity", *[F.col("counts")[i].alias(f"w{i + 1}") for i in range(3)])


@query(B, f"""{_PATHS} SELECT path_hash, w1, w2 FROM (SELECT substr(md5(path), 1, 10) AS path_hash, count(*) FILTER (first >= TIMESTAMP '1992-01-01' AND last < TIMESTAMP '1995-01-01') AS w1,
count(*) FILTER (first >= TIMESTAMP '1995-01-01' AND last < TIMESTAMP '1999-01-01') AS w2 FROM v WHERE object_type = 'order' AND path LIKE '%ship%' AND path NOT LIKE '%return%' GROUP BY path) WHERE w1 + w2 > 0""")
def variant_windows(log):
    a = lambda y: datetime(y, 1, 1, tzinfo=timezone.utc)
    v = stats.variant_windows(_cases(log, object_types=("order",)), [(a(1992), a(1995)), (a(1995), a(1999))], including=["ship"], excluding=["return"])
    return v.select("path_hash", F.col("counts")[0].alias("w1"), F.col("counts")[1].alias("w2"))


@query(A, f"""SELECT activity AS source, nxt AS target, count(*) AS frequency, round(avg({_d()}), 3) AS mean_seconds, min({_d()}) AS min_seconds, max({_d()}) AS max_seconds,
round(stddev_samp({_d()}), 3) AS stddev_seconds, count(*) FILTER ({_d()} > 3600) AS slow_count, round(avg(CASE WHEN {_d()} > 3600 THEN 1.0 ELSE 0 END), 6) AS slow_rate FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def edge_features(log):
    e = stats.edge_features(_cases(log), 3600.0)
    return e.select("source", "target", "frequency", F.round("mean_seconds", 3).alias("mean_seconds"), "min_seconds", "max_seconds", F.round("stddev_seconds", 3).alias("stddev_seconds"), "slow_count", F.round("slow_rate", 6).alias("slow_rate"))


@query(A, ", c AS (SELECT object_id, activity, nxt, count(*) AS n FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT activity AS source, nxt AS target, count(*) AS cases, CAST(sum(n - 1) AS BIGINT) AS repeats FROM c GROUP BY 1, 2")
def rework_transitions(log):
    return stats.rework(_cases(log))


@query(B, f"SELECT CAST(epoch_us(date_trunc('month', nxt_ts)) AS BIGINT) AS bucket_us, activity AS source, nxt AS target, count(*) AS frequency, round(avg({_d()}), 3) AS mean_seconds FROM y WHERE nxt IS NOT NULL AND object_type = 'order' GROUP BY 1, 2, 3")
def duration_series_month(log):
    d = stats.duration_series(_cases(log, object_types=("order",)), "month")
    return d.select(F.unix_micros("bucket").alias("bucket_us"), "source", "target", "frequency", F.round("mean_seconds", 3).alias("mean_seconds"))


_TOP = "t AS (SELECT * FROM v WHERE path = (SELECT path FROM v GROUP BY path ORDER BY count(*) DESC, substr(md5(path), 1, 10) LIMIT 1))"


@query(B, f"{_PATHS.replace('FROM y', chr(10) + 'FROM (SELECT * FROM y WHERE object_type = ' + chr(39) + 'order' + chr(39) + ')')}, {_TOP} SELECT CAST(epoch_us(date_trunc('week', first)) AS BIGINT) AS bucket_us, count(*) AS cases FROM t GROUP BY 1")
def timeline_week(log):
    return stats.timeline(_cases(log, object_types=("order",)), "week").select(F.unix_micros("bucket").alias("bucket_us"), "cases")


_ORDER_PATHS = _PATHS.replace("FROM y", "FROM (SELECT * FROM y WHERE object_type = 'order')")


@query(B, f"""{_ORDER_PATHS}, {_TOP}, s AS (SELECT {_d('last', 'first')} AS s FROM t), r AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT CAST(CASE WHEN lo = hi THEN 1 ELSE least(floor((s - lo) / ((hi - lo) / 19)) + 1, 19) END AS INTEGER) AS bin, count(*) AS count, min(s) AS min, max(s) AS max, round(avg(s), 3) AS mean FROM s, r GROUP BY 1""")
def throughput_hist(log):
    return stats.throughput_histogram(_cases(log, object_types=("order",))).withColumn("mean", F.round("mean", 3))


@query(A, f"""{_UPATHS}, s AS (SELECT {_d()} AS s FROM x WHERE activity = 'view' AND nxt = 'click'), r AS (SELECT min(s) AS lo, max(s) AS hi, count(*) AS n FROM s)
SELECT CAST(CASE WHEN lo = hi THEN 1 ELSE least(floor((s - lo) / ((hi - lo) / 19)) + 1, 19) END AS INTEGER) AS bin, count(*) AS count, round(count(*) * 100.0 / any_value(n), 6) AS percent FROM s, r GROUP BY 1""")
def edge_hist(log):
    return stats.edge_histogram(_cases(log), "view", "click", only_top=False).select("bin", "count", F.round("percent", 6).alias("percent"))


@query(B, """, e AS (SELECT activity AS s, nxt AS t, count(*) AS n FROM y WHERE nxt IS NOT NULL GROUP BY 1, 2), i AS (SELECT t AS activity, CAST(sum(n) AS BIGINT) AS frequency FROM e GROUP BY 1)
SELECT * FROM i UNION ALL SELECT s, CAST(sum(n) AS BIGINT) FROM e WHERE s NOT IN (SELECT activity FROM i) GROUP BY 1""")
def process_map_nodes(log):
    return stats.process_map(_cases(log))["nodes"]


@query(A, "SELECT activity, resource AS value, count(*) AS frequency FROM x GROUP BY 1, 2")
def process_map_by_resource(log):
    return stats.map_by(_full(log), "resource")


@query(B, f"{_ORDER_PATHS}, {_TOP} SELECT object_id AS execution_id, {_d('last', 'first')} AS seconds, events, path FROM t ORDER BY seconds DESC, execution_id LIMIT 50 OFFSET 10")
def case_page(log):
    return stats.case_page(_cases(log, object_types=("order",)), 50, 10).select("execution_id", "seconds", "events", "path")


_FILTERED = f""", f AS (SELECT object_id FROM x GROUP BY 1 HAVING bool_or(status = 'open') AND bool_or(activity = 'purchase') AND NOT bool_or(activity = 'signup' AND nxt = 'signup' AND {_d()} <= 7200)
AND bool_or(activity = 'view' AND nxt = 'purchase') AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 864000 * 1e6)"""
_FILTER = {"statuses": ["open"], "including": ["purchase"], "edges_in": [{"source": "view", "target": "purchase"}], "edges_out": [{"source": "signup", "target": "signup", "max": 7200.0}], "min_seconds": 864000.0}


@query(A, f"{_FILTERED} SELECT object_id AS execution_id FROM f")
def dynamic_filter_cases(log):
    return stats.dynamic_filter(_full(log), **_FILTER)


@query(A, f"""{_FILTERED}, e AS (SELECT activity AS source, nxt AS target, count(*) AS frequency, sum(epoch_us(nxt_ts) - epoch_us(ts)) / count(*) / 1e6 AS m FROM x WHERE nxt IS NOT NULL AND object_id IN (SELECT object_id FROM f) GROUP BY 1, 2)
SELECT source, target, frequency, round(m, 3) AS mean_seconds, CAST(row_number() OVER (ORDER BY m DESC, frequency DESC, source, target) AS INTEGER) AS rank FROM e""")
def dynamic_filter_dfg(log):
    return stats.dynamic_dfg(_full(log), **_FILTER).withColumn("mean_seconds", F.round("mean_seconds", 3))


@query(A, f"""SELECT object_id AS execution_id, count(*) AS events, string_agg(activity, '>' ORDER BY pos) AS path FROM x WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08' GROUP BY 1""")
def clipped_window(log):
    c = stats.clipped(_cases(log), _t(5), _t(8))
    return stats.case_summary(c).select("execution_id", "events", "path")


# --- views ---


@query(A, "SELECT event_id FROM x WHERE status = 'open' AND resource = 'r4' AND activity IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def view_events(log):
    v = View(start=_t(5), end=_t(20), activities=("click", "purchase"), statuses=("open",), event_attributes={"resource": "r4"})
    return executions.event_filter(log.events, v).select("event_id")


@query(B, """SELECT o_orderkey * 4 AS object_id FROM orders WHERE o_orderdate < TIMESTAMP '1996-06-01' AND o_orderpriority = '1-URGENT'
AND CASE WHEN o_orderdate + INTERVAL 7 DAY < TIMESTAMP '1996-06-01' THEN o_orderstatus ELSE 'N' END = 'F'""")
def view_objects_as_of(log):
    v = View(end=datetime(1996, 6, 1, tzinfo=timezone.utc), object_types=("order",), object_attributes={"priority": "1-URGENT", "status": "F"})
    return executions.object_filter(log, v).select("object_id")


@query(B, "SELECT DISTINCT o_custkey * 4 + 1 AS object_id FROM orders")
def view_related_types(log):
    return executions.object_filter(log, View(object_types=("customer",), related_object_types=("order",))).select("object_id")


@query(B, "SELECT count(DISTINCT (event_id, object_id)) AS n FROM eo WHERE qualifier IN ('part', 'supplier')")
def view_qualifiers(log):
    return executions.links(log, View(qualifiers=("part", "supplier"))).distinct().agg(F.count("*").alias("n"))


@query(B, f"{_PATHS} SELECT object_id AS execution_id FROM v WHERE object_type = 'order' AND {_d('last', 'first')} BETWEEN 8640000 AND 43200000")
def view_duration(log):
    return executions.leading(log, View(object_types=("order",), min_duration=8640000.0, max_duration=43200000.0), attributes=False).select("execution_id").distinct()


@query(A, "SELECT DISTINCT object_id AS execution_id FROM x WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-04'")
def population_event_time(log):
    return executions.population(log, "event_time", start=_t(3), end=_t(4))


@query(A, "SELECT object_id AS execution_id FROM x GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-01' AND min(ts) < TIMESTAMP '2024-01-02'")
def population_object_start(log):
    return executions.population(log, "object_start", start=_t(1), end=_t(2))


@query(A, "SELECT object_id AS execution_id FROM x GROUP BY 1 HAVING min(ts) >= TIMESTAMP '2024-01-01' AND max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
def population_contained(log):
    return executions.population(log, "contained", start=_t(1), end=_t(30, 12))


@query(A, "SELECT DISTINCT object_id AS execution_id FROM x WHERE object_id IN (3, 5, 999999)")
def population_case_set(log):
    return executions.population(log, "case_set", cases=[3, 5, 999999])


# --- constraints ---


def _ids(log: Log, c: dict, **view) -> DataFrame:
    return constraints.matches(log, c, View(**view)).select("execution_id")


@query(A, "SELECT object_id AS execution_id FROM x GROUP BY 1 HAVING bool_or(activity IN ('purchase', 'error'))")
def c_event_activity(log):
    return _ids(log, {"kind": "event_activity", "activities": ["purchase", "error"]})


@query(A, "SELECT object_id AS execution_id FROM x GROUP BY 1 HAVING bool_or(event_id IN (1, 20, 300)) AND object_id <> 7")
def c_ids(log):
    return _ids(log, {"kind": "and", "children": [{"kind": "event_id", "ids": [1, 20, 300]}, {"kind": "not", "child": {"kind": "object_id", "ids": [7]}}]})


@query(A, "SELECT object_id AS execution_id FROM x GROUP BY 1 HAVING bool_or(resource = 'r3')")
def c_event_attribute(log):
    return _ids(log, {"kind": "event_attribute", "name": "resource", "value": "r3"})


@query(B, """SELECT object_id AS execution_id FROM y JOIN orders ON object_id = o_orderkey * 4 WHERE object_type = 'order' GROUP BY object_id, o_orderstatus, o_orderdate
HAVING CASE WHEN o_orderdate + INTERVAL 7 DAY < max(ts) THEN o_orderstatus WHEN o_orderdate < max(ts) THEN 'N' END = 'F'""")
def c_object_attr_asof(log):
    return _ids(log, {"kind": "object_attribute", "name": "status", "value": "F"}, object_types=("order",))


@query(A, "SELECT object_id AS execution_id FROM x GROUP BY 1 HAVING bool_or(activity = 'signup' AND nxt = 'purchase')")
def c_directly_follows(log):
    return _ids(log, {"kind": "directly_follows", "a": "signup", "b": "purchase"})


@query(B, "SELECT object_id AS execution_id FROM y WHERE object_type = 'order' GROUP BY 1 HAVING min(pos) FILTER (activity = 'return') < max(pos) FILTER (activity = 'place')")
def c_eventually_follows(log):
    return _ids(log, {"kind": "eventually_follows", "a": "return", "b": "place"}, object_types=("order",))


@query(A, f"SELECT DISTINCT a.object_id AS execution_id FROM x a JOIN x b ON a.object_id = b.object_id AND b.pos > a.pos WHERE a.activity = 'signup' AND b.activity = 'purchase' AND {_d('b.ts', 'a.ts')} BETWEEN 600 AND 3600")
def c_temporal_distance(log):
    return _ids(log, {"kind": "temporal_distance", "a": "signup", "b": "purchase", "min": 600.0, "max": 3600.0})


@query(A, "SELECT object_id AS execution_id FROM x GROUP BY 1 HAVING count(*) FILTER (activity = 'error' AND resource = 'r1') BETWEEN 1 AND 2")
def c_child_count(log):
    child = {"kind": "and", "children": [{"kind": "event_activity", "activities": ["error"]}, {"kind": "event_attribute", "name": "resource", "value": "r1"}]}
    return _ids(log, {"kind": "child_count", "child": child, "min": 1, "max": 2})


@query(B, """, k AS (SELECT DISTINCT event_id, object_id FROM eo WHERE qualifier = 'part'), s AS (SELECT y.*, k.event_id IS NOT NULL AS part FROM y LEFT JOIN k USING (event_id, object_id))
SELECT object_id AS execution_id FROM s GROUP BY 1 HAVING count(*) FILTER (part) >= 2""")
def c_child_qualifier(log):
    return _ids(log, {"kind": "child_count", "child": {"kind": "e2o_qualifier", "qualifiers": ["part"]}, "min": 2})


@query(B, """, a AS (SELECT o_orderkey * 4 AS object_id, o_orderstatus AS status, o_orderdate + INTERVAL 7 DAY AS since FROM orders)
SELECT object_id AS execution_id FROM y JOIN a USING (object_id) WHERE object_type = 'order' GROUP BY 1 HAVING count(*) FILTER (since < ts AND status = 'F') BETWEEN 1 AND 3""")
def c_child_attribute(log):
    """Events after which an order's status, as of each, was F."""
    child = {"kind": "and", "children": [{"kind": "object_attribute", "name": "status", "value": "F"}, {"kind": "not", "child": {"kind": "relationship", "source_type": "order", "target_type": "order"}}]}
    return _ids(log, {"kind": "child_count", "child": child, "min": 1, "max": 3}, object_types=("order",))


@query(B, "SELECT object_id AS execution_id FROM ob WHERE object_type = 'order' AND object_id IN (SELECT object_id FROM y)")
def c_no_own_links(log):
    """No order is linked to itself, so all fit."""
    tree = {"kind": "not", "child": {"kind": "or", "children": [{"kind": "o2o_qualifier", "qualifiers": ["placed_by"]}, {"kind": "relationship", "source_type": "order", "target_type": "order"}]}}
    return _ids(log, tree, object_types=("order",))


@query(A, """SELECT object_id AS execution_id, CASE WHEN a AND b THEN 'buys,clean' WHEN a THEN 'buys' WHEN b THEN 'clean' ELSE '' END AS labels FROM
(SELECT object_id, bool_or(activity = 'signup' AND nxt = 'purchase') AS a, NOT bool_or(activity = 'error' AND nxt = 'error') AND NOT bool_or(activity = 'signup' AND nxt = 'purchase') AS b FROM x GROUP BY 1) WHERE a OR b""")
def c_bool_tree_labels(log):
    tree = {"kind": "or", "children": [
        {"kind": "label", "name": "buys", "child": {"kind": "directly_follows", "a": "signup", "b": "purchase"}},
        {"kind": "label", "name": "clean", "child": {"kind": "not", "child": {"kind": "directly_follows", "a": "error", "b": "error"}}},
    ]}
    return constraints.matches(log, tree).select("execution_id", F.array_join("labels", ",").alias("labels"))


@query(B, "SELECT DISTINCT object_id AS execution_id FROM eo JOIN ob USING (object_id) WHERE qualifier = 'supplier'")
def c_e2o_qualifier(log):
    return _ids(log, {"kind": "e2o_qualifier", "qualifiers": ["supplier"]})


@query(B, ", o AS (SELECT DISTINCT object_id FROM ob WHERE object_type = 'order'), c AS (SELECT object_id, count(DISTINCT event_id) AS n FROM eo JOIN ev USING (event_id) WHERE activity = 'ship' GROUP BY 1) SELECT object_id, coalesce(n, 0) AS n, NOT coalesce(n, 0) BETWEEN 1 AND 4 AS violated FROM o LEFT JOIN c USING (object_id)")
def binding_object_activity_count(log):
    return constraints.object_activity_count(log, "order", "ship", 1, 4)


@query(B, "SELECT object_id, NOT bool_or(activity = 'ship') AS violated FROM y WHERE object_type = 'order' GROUP BY 1 HAVING bool_or(activity = 'place')")
def binding_requires_activity(log):
    return constraints.requires_activity(log, "order", "place", "ship")


@query(B, ", e AS (SELECT event_id FROM ev WHERE activity = 'ship'), c AS (SELECT event_id, count(DISTINCT object_id) AS n FROM eo JOIN ob USING (object_id) WHERE object_type = 'supplier' GROUP BY 1) SELECT event_id, coalesce(n, 0) AS n, NOT coalesce(n, 0) BETWEEN 1 AND 1 AS violated FROM e LEFT JOIN c USING (event_id)")
def binding_event_object_count(log):
    return constraints.event_object_count(log, "supplier", "ship", 1, 1)


@query(B, """, s AS (SELECT object_id, min(ts) AS t FROM y WHERE object_type = 'customer' AND activity = 'place' GROUP BY 1), g AS (SELECT object_id, max(ts) AS t FROM y WHERE object_type = 'order' AND activity = 'return' GROUP BY 1),
n AS (SELECT DISTINCT o_custkey * 4 + 1 AS source, o_orderkey * 4 AS target FROM orders)
SELECT s.object_id AS source, NOT max(coalesce(g.t > s.t, false)) AS violated FROM s LEFT JOIN n ON n.source = s.object_id LEFT JOIN g ON g.object_id = n.target GROUP BY 1""")
def binding_neighbor_eventually(log):
    return constraints.neighbor_eventually(log, "customer", "place", "order", "return")


@query(B, f"SELECT max(d) AS value FROM (SELECT (epoch_us(max(ts) FILTER (activity = 'ship')) - epoch_us(min(ts) FILTER (activity = 'place'))) / 1e6 AS d FROM y WHERE object_type = 'order' GROUP BY object_id)")
def binding_max_delay(log):
    return constraints.max_activity_delay(log, "order", "place", "ship")


@query(B, "SELECT o_custkey * 4 + 1 AS source, count(DISTINCT o_orderkey) AS targets FROM orders GROUP BY 1")
def binding_neighbor_pairs(log):
    return constraints.neighbor_pairs(log, "customer", "order").select("source", F.size("targets").cast("long").alias("targets"))


@query(B, "SELECT DISTINCT o_custkey * 4 + 1 AS source, o_orderkey * 4 AS target, o_orderstatus IS NOT NULL AS violated FROM orders")
def binding_attribute_equal(log):
    return constraints.neighbor_attribute_equal(log, "customer", "order", "status")


@query(B, """SELECT p.l_orderkey * 4 AS source, bool_or(o.supp IS NULL) AS violated FROM (SELECT DISTINCT l_orderkey, l_partkey FROM li) p JOIN (SELECT DISTINCT l_partkey, supp FROM li) r ON p.l_partkey = r.l_partkey
LEFT JOIN (SELECT DISTINCT l_orderkey, supp FROM li) o ON o.l_orderkey = p.l_orderkey AND o.supp = r.supp GROUP BY 1""")
def binding_universal_equal(log):
    return constraints.relation_universal_equal(log, "order", "part", "supplier")


@query(B, "SELECT object_id, e AS source_event, t AS target_event FROM (SELECT object_id, event_id AS e, activity, first_value(CASE WHEN activity = 'return' THEN event_id END IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM y WHERE object_type = 'order' AND activity IN ('ship', 'return')) WHERE activity = 'ship' AND t IS NOT NULL")
def event_pairs(log):
    return constraints.event_pairs(log, "order", "ship", "return")


# --- count kernels ---

_SPLIT = "ts < TIMESTAMP '2024-01-20'"
_EDGES = f", k AS (SELECT activity AS source, nxt AS target, count(*) FILTER ({_SPLIT}) AS train, count(*) FILTER (NOT {_SPLIT}) AS test FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2)"


def _edge_rows(log: Log) -> DataFrame:
    return kernels.split_counts(_cases(log).filter("next_activity is not null"), F.col("ts") < F.lit(_t(20)), {"source": F.col("activity"), "target": F.col("next_activity")})


def _coverage_sql(keys: str, table: str, c: float) -> str:
    return f""", m AS (SELECT *, coalesce(sum(train) OVER (ORDER BY train DESC, {keys} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(train) OVER () AS t FROM {table})
SELECT CAST(coalesce(sum(test) FILTER (ok), 0) AS BIGINT) AS conforming, CAST(coalesce(sum(test) FILTER (NOT ok), 0) AS BIGINT) AS deviations, count(*) FILTER (ok) AS model_size,
round(coalesce(sum(test) FILTER (ok), 0) / sum(test), 9) AS fitness FROM (SELECT *, train > 0 AND b < ceil(t * {c} - 1e-9) AS ok FROM m)"""


@query(A, _EDGES + _coverage_sql("source, target", "k", 0.95))
def dfg_conformance_95(log):
    return kernels.frequency_conformance(_edge_rows(log), ["source", "target"], 0.95).withColumn("fitness", F.round("fitness", 9))


@query(B, f"{_ORDER_PATHS}, k AS (SELECT path, count(*) FILTER (first < TIMESTAMP '1996-01-01') AS train, count(*) FILTER (first >= TIMESTAMP '1996-01-01') AS test FROM v GROUP BY 1)" + _coverage_sql("path", "k", 0.95))
def variant_conformance_95(log):
    s = stats.case_summary(_cases(log, object_types=("order",)))
    rows = kernels.split_counts(s, F.col("first") < F.lit(datetime(1996, 1, 1, tzinfo=timezone.utc)), {"path": F.col("path")})
    return kernels.frequency_conformance(rows, ["path"], 0.95).withColumn("fitness", F.round("fitness", 9))


@query(A, f"{_EDGES} SELECT source, target AS predicted, train FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY train DESC, target) AS r FROM k WHERE train > 0) WHERE r = 1")
def next_activity(log):
    return kernels.next_activity(_edge_rows(log))


@query(A, f"{_EDGES}, p AS (SELECT source, target AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY train DESC, target) AS r FROM k WHERE train > 0) WHERE r = 1) SELECT CAST(sum(test) FILTER (target = predicted) AS BIGINT) AS correct, CAST(sum(test) AS BIGINT) AS total, round(sum(test) FILTER (target = predicted) / sum(test), 9) AS accuracy FROM k LEFT JOIN p USING (source)")
def next_activity_score(log):
    return kernels.score_next(_edge_rows(log)).withColumn("accuracy", F.round("accuracy", 9))


@query(A, f"""{_EDGES}, q AS (SELECT source || '>' || target AS label, train / sum(train) OVER () AS p, test / sum(test) OVER () AS q FROM k)
SELECT label, round(greatest((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 0), 9) AS contribution FROM q""")
def frequency_drift(log):
    rows = _edge_rows(log).select(F.concat_ws(">", "source", "target").alias("label"), F.col("train").alias("baseline"), F.col("test").alias("current"))
    return kernels.drift_terms(rows, "label").select("label", F.round("contribution", 9).alias("contribution"))


@query(A, "SELECT source, target, CAST(row_number() OVER (ORDER BY m DESC, frequency DESC, source, target) AS INTEGER) AS rank FROM (SELECT activity AS source, nxt AS target, count(*) AS frequency, sum(epoch_us(nxt_ts) - epoch_us(ts)) / count(*) / 1e6 AS m FROM x WHERE nxt IS NOT NULL GROUP BY 1, 2)")
def bottleneck_rank(log):
    return enhancement.ranked_edges(_cases(log)).select("source", "target", "rank")


@query(A, f"""SELECT sum(n) AS n, round(sqrt(sum(sq - 2 * m * s + n * m * m) / sum(n)), 3) AS rmse, round(sum(sl * (1 - r) * (1 - r) + (n - sl) * r * r) / sum(n), 9) AS brier FROM
(SELECT CAST(count(*) FILTER (NOT {_SPLIT}) AS DOUBLE) AS n, avg({_d()}) FILTER ({_SPLIT}) AS m, avg(CASE WHEN {_d()} > 3600 THEN 1.0 ELSE 0 END) FILTER ({_SPLIT}) AS r, sum({_d()}) FILTER (NOT {_SPLIT}) AS s,
sum({_d()} * {_d()}) FILTER (NOT {_SPLIT}) AS sq, count(*) FILTER (NOT {_SPLIT} AND {_d()} > 3600) AS sl FROM x WHERE nxt IS NOT NULL GROUP BY activity, nxt)""")  # fmt: skip
def edge_prediction(log):
    cases = _cases(log)
    early = F.col("ts") < F.lit(_t(20))
    train = stats.edge_features(cases.filter(early), 3600.0).select("source", "target", "mean_seconds", "slow_rate")
    d = F.col("duration")
    test = stats.steps(cases.filter(~early)).groupBy(F.col("activity").alias("source"), F.col("next_activity").alias("target")).agg(F.count("*").alias("frequency"), F.avg(d).alias("mean_seconds"), F.sum(d * d).alias("sum_squares"), F.count_if(d > 3600).alias("slow_count"))
    p = kernels.edge_prediction(train, test, ["source", "target"])
    return p.select(F.col("n").cast("double").alias("n"), F.round("rmse", 3).alias("rmse"), F.round("brier", 9).alias("brier"))


# --- discovery and conformance ---


@query(A, "SELECT activity AS a, count(DISTINCT object_id) AS holds FROM x GROUP BY 1 HAVING count(DISTINCT object_id) >= 0.8 * (SELECT count(DISTINCT object_id) FROM x)")
def declare_existence(log):
    return discovery.declare(_cases(log)).filter("template = 'existence'").select("a", "holds")


@query(B, """, m AS (SELECT object_id, activity, max(pos) AS last FROM y WHERE object_type = 'order' GROUP BY 1, 2), t AS (SELECT count(DISTINCT object_id) AS n FROM m), c AS (SELECT activity, count(*) AS w FROM m GROUP BY 1),
p AS (SELECT i.activity AS a, j.activity AS b, count(*) AS met FROM m i JOIN m j ON i.object_id = j.object_id AND i.activity <> j.activity AND i.last < j.last GROUP BY 1, 2)
SELECT a, b, met + n - w AS holds FROM p JOIN c ON c.activity = a, t WHERE (met + n - w) / n >= 0.5""")
def declare_response(log):
    return discovery.declare(_cases(log, object_types=("order",)), 0.5).filter("template = 'response'").select("a", "b", "holds")


def _rows(spark_log: Log, rows: list, schema: str) -> DataFrame:
    return spark_log.events.sparkSession.createDataFrame(rows, schema)


_RELATED = f""", t AS (SELECT DISTINCT a.object_id, ob.object_type FROM eo a JOIN eo b ON a.event_id = b.event_id AND a.object_id <> b.object_id JOIN ob ON ob.object_id = b.object_id WHERE a.object_id % 4 = 0
UNION SELECT o_orderkey * 4, 'customer' FROM orders)"""


@query(B, f"{_RELATED} SELECT object_id AS execution_id FROM t WHERE object_id IN (SELECT object_id FROM y WHERE object_type = 'order') GROUP BY 1 HAVING bool_or(object_type = 'customer') AND NOT bool_or(object_type = 'part')")
def dynamic_filter_related(log):
    """Orders that were placed and never shipped."""
    return stats.dynamic_filter(_cases(log, object_types=("order",)), related=constraints.related_types(log), related_in=["customer"], related_out=["part"])


@query(B, f"{_ORDER_PATHS}, {_TOP}, g AS (SELECT object_id FROM t ORDER BY {_d('last', 'first')} DESC, object_id LIMIT 50 OFFSET 10) SELECT g.object_id AS execution_id, count(DISTINCT b.object_id) AS objects FROM g JOIN eo a ON a.object_id = g.object_id JOIN eo b ON b.event_id = a.event_id GROUP BY 1")
def case_page_objects(log):
    return stats.case_page(_cases(log, object_types=("order",)), 50, 10, log=log).select("execution_id", F.size("objects").cast("long").alias("objects"))


@query(B, "SELECT o_orderkey * 4 AS source, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def binding_relation_children(log):
    return constraints.relation_children(log, "order", "customer")


@query(B, "SELECT 'placed' AS binding, count(*) AS rows, count(*) FILTER (n <> 1) AS hits FROM (SELECT o_orderkey, 1 AS n FROM orders) UNION ALL SELECT 'linked', count(*), count(*) FILTER (n > 0) FROM (SELECT o_orderkey, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)")
def binding_tree(log):
    """A prepared tree of two bindings."""
    tree = {"operator": "object_activity_count", "name": "placed", "arguments": {"object_type": "order", "activity": "place", "least": 1, "most": 1}, "children": [{"operator": "relation_children", "name": "linked", "arguments": {"source_type": "order", "target_type": "customer"}}]}
    t = constraints.prepare(log, tree)
    one = lambda name, hit: t[name].agg(F.lit(name).alias("binding"), F.count("*").alias("rows"), F.count_if(hit).alias("hits"))
    return one("placed", F.col("violated")).union(one("linked", F.col("n") > 0))


@query(B)
def alpha_net(log):
    net = discovery.alpha(_cases(log, object_types=("order",)))
    return _rows(log, [(a[0], a[1]) for a in net["arcs"]], "source string, target string")


@query(B)
def process_tree(log):
    from tracelake.model import canonical_json

    return _rows(log, [(canonical_json(discovery.process_tree(_cases(log, object_types=("order",)))),)], "tree string")


@query(B)
def object_net(log):
    net = discovery.object_net(_cases(log))
    return _rows(log, [tuple(a) for a in net["arcs"]], "source string, target string, object_type string, variable boolean")


def _model(c: DataFrame) -> dict:
    """The graph of cases that begin before 1996."""
    first = F.min("ts").over(executions.Window.partitionBy("execution_id"))
    return discovery.graph(c.withColumn("_f", first).filter(F.col("_f") < F.lit(datetime(1996, 1, 1, tzinfo=timezone.utc))))


@query(B, """, f AS (SELECT *, min(ts) OVER (PARTITION BY object_id) AS a FROM y WHERE object_type = 'order'), m AS (SELECT DISTINCT activity, nxt FROM f WHERE nxt IS NOT NULL AND a < TIMESTAMP '1996-01-01'),
s AS (SELECT f.object_id, m.activity IS NOT NULL AS ok FROM f LEFT JOIN m ON f.activity = m.activity AND f.nxt = m.nxt WHERE f.nxt IS NOT NULL)
SELECT count(*) AS steps, count(*) FILTER (ok) AS conforming, round(count(*) FILTER (ok) / count(*), 9) AS fitness, count(DISTINCT object_id) FILTER (NOT ok) AS violating_executions,
round((SELECT count(*) FROM m SEMI JOIN (SELECT activity, nxt FROM f) USING (activity, nxt)) / greatest((SELECT count(*) FROM m), 1), 9) AS precision, round(1.0 / (1 + (SELECT count(*) FROM m)), 9) AS simplicity FROM s""")
def conformance_frequency(log):
    cases = _twice(_cases(log, object_types=("order",)))
    c = conformance.frequency_coverage(cases, _model(cases))
    return _rounded(c, "fitness", "precision", "simplicity", digits=9)


@query(B)
def token_replay(log):
    cases = _twice(_cases(log, object_types=("order",)))
    return conformance.token_replay(cases, discovery.alpha(cases))


@query(B)
def alignment(log):
    cases = _twice(_cases(log, object_types=("order",)))
    return conformance.alignment(cases, _model(cases))


_TEMPLATES = [{"template": t, "a": "place", "b": None if t in ("existence", "absence", "exactly", "init", "end") else "ship"} for t in conformance.TEMPLATES]
_TEMPLATE_SQL = {
    "existence": "na > 0", "absence": "na = 0", "exactly": "na = 1", "init": "f = 'place'", "end": "l = 'place'", "response": "na = 0 OR (nb > 0 AND ha < hb)", "precedence": "nb = 0 OR (na > 0 AND la < lb)",
    "succession": "(na = 0 OR (nb > 0 AND ha < hb)) AND (nb = 0 OR (na > 0 AND la < lb))", "coexistence": "(na > 0) = (nb > 0)", "not_coexistence": "NOT (na > 0 AND nb > 0)", "choice": "na > 0 OR nb > 0", "exclusive_choice": "(na > 0) <> (nb > 0)",
}


@query(B, """, c AS (SELECT object_id, count(*) FILTER (activity = 'place') AS na, count(*) FILTER (activity = 'ship') AS nb, min(pos) FILTER (activity = 'place') AS la, max(pos) FILTER (activity = 'place') AS ha,
min(pos) FILTER (activity = 'ship') AS lb, max(pos) FILTER (activity = 'ship') AS hb, arg_min(activity, pos) AS f, arg_max(activity, pos) AS l FROM y WHERE object_type = 'order' GROUP BY 1)
""" + " UNION ALL ".join(f"SELECT '{k}' AS template, count(*) FILTER ({v}) AS holds FROM c" for k, v in _TEMPLATE_SQL.items()))  # fmt: skip
def declare_check(log):
    return conformance.check_declare(_cases(log, object_types=("order",)), _TEMPLATES).select("template", "holds")


# --- enhancement ---


@query(B, f"""{_ORDER_PATHS}, s AS (SELECT {_d('last', 'first')} AS s FROM v), r AS (SELECT min(s) AS lo, max(s) AS hi FROM s)
SELECT CAST(CASE WHEN lo = hi THEN 1 ELSE least(floor((s - lo) / ((hi - lo) / 10)) + 1, 10) END AS INTEGER) AS bin, count(*) AS count FROM s, r GROUP BY 1""")
def enh_cycle_hist(log):
    return enhancement.cycle_histogram(_cases(log, object_types=("order",))).select("bin", "count")


@query(A, f"SELECT event_id, activity, {_d('ts', 'min(ts) OVER (PARTITION BY object_id)')} AS offset FROM x")
def enh_dotted_chart(log):
    return enhancement.dotted_chart(_cases(log)).select("event_id", "activity", "offset")


@query(B, ", c AS (SELECT object_id, activity, count(*) AS n FROM y WHERE object_type = 'order' GROUP BY 1, 2 HAVING count(*) > 1) SELECT activity, count(*) AS cases, CAST(sum(n - 1) AS BIGINT) AS repeats FROM c GROUP BY 1")
def enh_rework(log):
    return enhancement.rework(_cases(log, object_types=("order",)))


_STATS = "count(*) AS support, round(avg(v), 3) AS mean, round(min(v), 3) AS minimum, round(max(v), 3) AS maximum, round(quantile_cont(v, 0.5), 3) AS median"
#: Starts and completes of each case and activity, paired first in, first out.
_PAIRS = """, w0 AS (SELECT *, CASE lifecycle WHEN 'start' THEN 1 ELSE -1 END AS way, max(CASE WHEN lifecycle = 'complete' THEN ts END) OVER (PARTITION BY object_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done,
lag(ts) OVER (PARTITION BY object_id ORDER BY pos) AS before FROM x), w1 AS (SELECT *, sum(way) OVER (PARTITION BY object_id, activity ORDER BY pos) AS s FROM w0),
w2 AS (SELECT *, least(0, min(s) OVER (PARTITION BY object_id, activity ORDER BY pos)) AS m FROM w1), w3 AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY object_id, activity ORDER BY pos), 0) AS b FROM w2),
w4 AS (SELECT *, row_number() OVER (PARTITION BY object_id, activity, way ORDER BY pos) AS nth FROM w3 WHERE way = 1 OR m = b),
work AS MATERIALIZED (SELECT i.object_id, i.activity, coalesce(i.before, i.ts) AS ready, i.ts AS start, j.ts AS complete, coalesce(j.resource, i.resource) AS resource, i.event_id AS start_event, j.event_id AS complete_event, j.done,
row_number() OVER (ORDER BY i.object_id, j.ts, j.event_id) AS id FROM w4 i JOIN w4 j ON i.object_id = j.object_id AND i.activity = j.activity AND i.nth = j.nth AND i.way = 1 AND j.way = -1 AND j.ts >= i.ts)"""


_METRICS = ("mean", "minimum", "maximum", "median")


@query(A, f"""{_PAIRS}, m AS (SELECT 'directly_follows' AS metric, {_d()} AS v FROM x WHERE nxt IS NOT NULL UNION ALL SELECT 'cycle', {_d('max(ts)', 'min(ts)')} FROM x GROUP BY object_id
UNION ALL SELECT 'service', {_d('complete', 'start')} FROM work UNION ALL SELECT 'waiting', {_d('start', 'done')} FROM work WHERE done <= start UNION ALL SELECT 'sojourn', {_d('complete', 'done')} FROM work WHERE done IS NOT NULL
UNION ALL SELECT unnest(['flow', 'pooling', 'lagging']), {_d()} FROM x WHERE nxt IS NOT NULL) SELECT metric, {_STATS} FROM m GROUP BY 1""")  # fmt: skip
def enh_performance(log):
    return _rounded(enhancement.performance(executions.leading(log, attributes=False)), *_METRICS)


@query(B, f""", r AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY object_id ORDER BY pos) AS ready FROM y), g AS (SELECT event_id, any_value(ts) AS ts, min(ready) AS lo, max(ready) AS hi, count(ready) AS k FROM r GROUP BY 1),
m AS (SELECT 'flow' AS metric, {_d('ts', 'ready')} AS v FROM r WHERE ready IS NOT NULL UNION ALL SELECT 'pooling', {_d('ts', 'hi')} FROM g WHERE k > 0 UNION ALL SELECT 'lagging', {_d('ts', 'lo')} FROM g WHERE k > 0
UNION ALL SELECT 'synchronization', {_d('hi', 'lo')} FROM g WHERE k > 1) SELECT metric, {_STATS} FROM m GROUP BY 1""")  # fmt: skip
def enh_synchronisation(log):
    p = enhancement.performance(executions.components(log, attributes=False)).filter("metric in ('flow', 'pooling', 'lagging', 'synchronization')")
    return _rounded(p, *_METRICS)


@query(A, "SELECT resource AS source, nr AS target, count(*) AS frequency FROM (SELECT resource, lead(resource) OVER (PARTITION BY object_id ORDER BY pos) AS nr FROM x) WHERE nr IS NOT NULL GROUP BY 1, 2")
def org_handover(log):
    return enhancement.organisation(_full(log))["handovers"]


@query(A, "SELECT resource, count(DISTINCT object_id) AS executions FROM x GROUP BY 1")
def org_executions(log):
    return enhancement.organisation(_full(log))["executions"]


@query(A, """, b AS (SELECT activity AS label, count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS p0, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS q0 FROM x GROUP BY 1), s AS (SELECT label, p0 / sum(p0) OVER () AS p, q0 / sum(q0) OVER () AS q FROM b)
SELECT round(sum(greatest((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) / 2 ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) / 2 ELSE 0 END), 0)), 9) AS divergence FROM s""")
def window_comparison(log):
    a, b = (executions.ordered(executions.leading(log, v, attributes=False)) for v in (View(end=_t(15)), View(start=_t(15))))
    return enhancement.compare(a, b, "activity")["divergence"].select(F.round("divergence", 9).alias("divergence"))


# --- bottlenecks ---

_SIG = f""", o AS (SELECT activity AS s, nxt AS t, {_d()} AS d FROM x WHERE nxt IS NOT NULL), q AS (SELECT s, t, count(*) AS support, avg(d) AS mean, quantile_cont(d, 0.5) AS med, quantile_cont(d, 0.9) AS p90, quantile_cont(d, 0.95) AS p95,
quantile_cont(d, 0.75) + 1.5 * (quantile_cont(d, 0.75) - quantile_cont(d, 0.25)) AS thr FROM o GROUP BY 1, 2)"""


@query(A, f"""{_SIG} SELECT s AS source_activity, t AS target_activity, any_value(support) AS support, round(any_value(mean), 3) AS mean, round(any_value(med), 3) AS median, round(any_value(p90), 3) AS p90, round(any_value(p95), 3) AS p95,
round(any_value(thr), 3) AS threshold, count(*) FILTER (d > thr) AS affected, round(avg(d) FILTER (d >= p95), 3) AS tail_mean, round(sum(greatest(d - thr, 0)), 2) AS impact FROM o JOIN q USING (s, t) GROUP BY 1, 2""")  # fmt: skip
def bn_signals(log):
    s = bottlenecks.signals(executions.observations(log))
    r = lambda c, n=3: F.round(c, n).alias(c)
    return s.select("source_activity", "target_activity", "support", r("mean"), r("median"), r("p90"), r("p95"), r("threshold"), "affected", r("tail_mean"), r("impact", 2))


@query(B, f""", o AS (SELECT object_type, object_id, ts AS st, nxt_id AS te, nxt AS activity FROM y WHERE nxt_id IS NOT NULL), w AS (SELECT te, max(st) AS last FROM o GROUP BY 1 HAVING count(DISTINCT object_type) >= 2)
SELECT activity, object_type, count(*) AS n, round(avg((epoch_us(last) - epoch_us(st)) / 1e6), 3) AS mean_lag FROM o JOIN w USING (te) GROUP BY 1, 2""")
def bn_synchronization(log):
    return bottlenecks.synchronisation_lag(executions.observations(log)).withColumn("mean_lag", F.round("mean_lag", 3))


def _work(log: Log) -> DataFrame:
    return bottlenecks.instances(executions.leading(log))


@query(A, f"{_PAIRS} SELECT object_id, activity, CAST(epoch_us(ready) AS BIGINT) AS ready_us, CAST(epoch_us(start) AS BIGINT) AS start_us, CAST(epoch_us(complete) AS BIGINT) AS complete_us, resource, start_event, complete_event FROM work")
def bn_instances(log):
    return _work(log).select("object_id", "activity", *[F.unix_micros(c).alias(f"{c}_us") for c in ("ready", "start", "complete")], "resource", "start_event", "complete_event")


#: Batches of starts within a minute of each other, and unions of a resource's work.
_BATCHES = f"""{_PAIRS}, b0 AS (SELECT *, CASE WHEN {_d('start', 'lag(start) OVER w')} <= 60 THEN 0 ELSE 1 END AS new FROM work WINDOW w AS (PARTITION BY activity, resource ORDER BY start, id)),
b1 AS (SELECT *, sum(new) OVER (PARTITION BY activity, resource ORDER BY start, id) AS batch FROM b0), b AS (SELECT *, count(*) OVER g AS size, max(ready) OVER g AS release FROM b1 WINDOW g AS (PARTITION BY activity, resource, batch))"""
_MERGE = """{n}0 AS (SELECT {k}, start AS s, complete AS e, CASE WHEN start <= max(complete) OVER (PARTITION BY {k} ORDER BY start, complete ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM work),
{n}1 AS (SELECT *, sum(new) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM {n}0), {n} AS MATERIALIZED (SELECT {k}, min(s) AS s, max(e) AS e FROM {n}1 GROUP BY {k}, i)"""
_CAUSES = ["batching", "contention", "prioritization", "unavailability"]
@query(A, f"""{_BATCHES}, {_MERGE.format(n='z', k='resource')},
c AS (SELECT w.id, sum({_d('least(z.e, w.start)', 'greatest(z.s, w.ready)')}) AS busy FROM work w JOIN z ON w.resource = z.resource AND z.s < w.start AND z.e > w.ready GROUP BY 1),
o AS (SELECT a.id, min(j.start) AS first FROM work a JOIN work j ON a.resource = j.resource AND j.ready > a.ready AND j.start < a.start GROUP BY 1),
h AS (SELECT * FROM (VALUES (TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03 08:00:00'), (TIMESTAMP '2024-01-03 16:00:00', TIMESTAMP '2024-01-31')) AS t(lo, hi)),
av AS (SELECT w.id, sum(greatest(0, {_d('least(hi, w.start)', 'greatest(lo, w.ready)')})) AS there FROM work w, h WHERE resource = 'r1' GROUP BY 1),
f AS (SELECT b.*, {_d('start', 'ready')} AS total, CASE WHEN size >= 2 THEN {_d('release', 'ready')} ELSE 0 END AS w1, coalesce(busy, 0) AS w2, coalesce({_d('start', 'first')}, 0) AS w3, coalesce({_d('start', 'ready')} - there, 0) AS w4
FROM b LEFT JOIN c USING (id) LEFT JOIN o USING (id) LEFT JOIN av USING (id)),
g1 AS (SELECT *, least(w1, total) AS batching FROM f), g2 AS (SELECT *, least(w2, total - batching) AS contention FROM g1), g3 AS (SELECT *, least(w3, total - batching - contention) AS prioritization FROM g2),
g4 AS (SELECT *, least(w4, total - batching - contention - prioritization) AS unavailability FROM g3)
SELECT activity, resource, count(*) AS support, round(sum(total), 3) AS waiting, {", ".join(f"round(sum({c}), 3) AS {c}" for c in _CAUSES)}, round(sum(total - {" - ".join(_CAUSES)}), 3) AS extraneous FROM g4 GROUP BY 1, 2""")  # fmt: skip
def bn_waiting_causes(log):
    there = _rows(log, [("r1", _t(1), _t(3, 8)), ("r1", _t(3, 16), _t(31))], "resource string, lo timestamp, hi timestamp")
    return _rounded(bottlenecks.waiting_causes(_work(log), 60.0, calendars=there), "waiting", *_CAUSES, "extraneous")


@query(A, f"""{_PAIRS}, {_MERGE.format(n='z', k='activity, resource')}, p AS (SELECT activity, resource, sum(epoch_us(e) - epoch_us(s)) AS busy FROM z GROUP BY 1, 2),
q0 AS (SELECT activity, resource, ready AS t, 1 AS chg FROM work UNION ALL SELECT activity, resource, start, -1 FROM work), q1 AS (SELECT *, sum(chg) OVER (PARTITION BY activity, resource ORDER BY t, chg DESC ROWS UNBOUNDED PRECEDING) AS q FROM q0),
q AS (SELECT activity, resource, CAST(max(q) AS BIGINT) AS max_queue FROM q1 GROUP BY 1, 2),
s AS (SELECT *, min(epoch_us(ready)) OVER g AS lo, max(epoch_us(complete)) OVER g - min(epoch_us(ready)) OVER g AS w, epoch_us(ready) AS r, epoch_us(start) AS b, epoch_us(complete) AS c FROM work WINDOW g AS (PARTITION BY activity, resource)),
k AS (SELECT activity, resource, any_value(w) AS w, count(*) AS support, count(*) FILTER (2 * r >= 2 * lo + w) AS a, count(*) FILTER (2 * c >= 2 * lo + w) AS t, count(*) FILTER (4 * r <= 4 * lo + 3 * w AND 4 * b > 4 * lo + 3 * w) - count(*) FILTER (4 * r <= 4 * lo + w AND 4 * b > 4 * lo + w) AS backlog_change,
avg((b - r) / 1e6) AS mean_wait, quantile_cont((b - r) / 1e6, 0.95) AS p95_wait, avg((c - b) / 1e6) AS mean_service FROM s GROUP BY 1, 2), h AS (SELECT *, a / greatest(w / 2 / 3.6e9, 1 / 3600) AS ar, t / greatest(w / 2 / 3.6e9, 1 / 3600) AS tr FROM k)
SELECT activity, resource, support, round(ar, 6) AS arrival_rate, round(tr, 6) AS throughput_rate, round(busy / w, 6) AS utilization, round(mean_wait, 3) AS mean_wait, round(p95_wait, 3) AS p95_wait, round(mean_service, 3) AS mean_service, max_queue, backlog_change, ar > tr * 1.01 OR backlog_change > 0 AS unstable
FROM h JOIN p USING (activity, resource) JOIN q USING (activity, resource)""")  # fmt: skip
def bn_resource_pressure(log):
    return _rounded(_rounded(bottlenecks.resource_pressure(_work(log)), "arrival_rate", "throughput_rate", "utilization", digits=6), "mean_wait", "p95_wait", "mean_service")


@query(A, f"""{_BATCHES}, g AS (SELECT *, abs({_d('ready', 'lag(ready) OVER (PARTITION BY activity, resource ORDER BY start, id)')}) AS gap FROM b),
s AS (SELECT activity, resource, count(*) AS support, count(*) FILTER (size >= 2) / count(*) AS batch_rate, coalesce(avg(gap), 0) AS mu, coalesce(stddev_pop(gap), 0) AS sd FROM g GROUP BY 1, 2),
i AS (SELECT a.activity, a.resource, count(*) AS n FROM work a JOIN work j ON a.activity = j.activity AND a.resource = j.resource AND (a.start, a.id) < (j.start, j.id) AND a.ready > j.ready GROUP BY 1, 2)
SELECT activity, resource, support, round(batch_rate, 9) AS batch_rate, round(coalesce(n, 0) / greatest(support * (support - 1) / 2, 1), 9) AS overtaking, round(CASE WHEN sd + mu > 0 THEN (sd - mu) / (sd + mu) ELSE 0 END, 6) AS burstiness FROM s LEFT JOIN i USING (activity, resource)""")  # fmt: skip
def bn_patterns(log):
    return _rounded(_rounded(bottlenecks.patterns(_work(log), 60.0), "batch_rate", "overtaking", digits=9), "burstiness", digits=6)


@query(A, f"""{_PAIRS}, c AS (SELECT a.id, j.id AS blk, epoch_us(least(a.start, j.complete)) - epoch_us(greatest(a.ready, j.start)) AS o FROM work a JOIN work j ON a.resource = j.resource AND a.id <> j.id AND j.start < a.start AND j.complete > a.ready WHERE a.start > a.ready),
k AS MATERIALIZED (SELECT id, blk, o FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC, blk DESC) AS r FROM c WHERE o > 0) WHERE r = 1),
t AS (WITH RECURSIVE t(id, cur, path, delay) AS (SELECT id, id, [activity], CAST(0 AS BIGINT) FROM work UNION ALL SELECT t.id, k.blk, list_append(t.path, w.activity), t.delay + k.o FROM t JOIN k ON t.cur = k.id JOIN work w ON w.id = k.blk WHERE len(t.path) < 32) SELECT * FROM t),
l AS (SELECT id, arg_max(path, len(path)) AS path, max(delay) AS delay FROM t GROUP BY 1)
SELECT array_to_string(path, '>') AS activities, resource, count(*) AS support, CAST(len(any_value(path)) - 1 AS INTEGER) AS depth, round(sum(l.delay) / 1e6, 3) AS delay FROM l JOIN work USING (id) WHERE len(path) > 1 GROUP BY 1, 2""")  # fmt: skip
def bn_cascades(log):
    return _rounded(bottlenecks.cascades(_work(log)).withColumn("activities", F.array_join("activities", ">")), "delay")


_HALVES = f""", o AS (SELECT activity AS s, nxt AS t, {_d()} AS d, CASE WHEN nxt_ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS side FROM x WHERE nxt IS NOT NULL AND (nxt_ts < TIMESTAMP '2024-01-15' OR ts >= TIMESTAMP '2024-01-15'))"""


@query(A, f"""{_HALVES}, z AS (SELECT s, t, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1, quantile_cont(d, [0.25, 0.5, 0.75, 0.95]) FILTER (side = 0) AS q0, quantile_cont(d, [0.25, 0.5, 0.75, 0.95]) FILTER (side = 1) AS q1 FROM o GROUP BY 1, 2),
l AS (SELECT *, q0[3] + 1.5 * (q0[3] - q0[1]) AS cap FROM z WHERE n0 > 0 AND n1 > 0), c AS (SELECT o.*, n0, n1, q0, q1, cap, sum(1 - side) OVER w AS c0, sum(side) OVER w AS c1 FROM o JOIN l USING (s, t) WINDOW w AS (PARTITION BY s, t ORDER BY d RANGE UNBOUNDED PRECEDING)),
k AS (SELECT s, t, any_value(n0) AS n0, any_value(n1) AS n1, any_value(q1[2] - q0[2]) AS m, any_value(q1[4] - q0[4]) AS p95, sum(greatest(d - cap, 0) * (2 * side - 1)) AS impact, max(abs(c0 / n0 - c1 / n1)) AS ks FROM c GROUP BY 1, 2),
p AS (SELECT *, sqrt(n0 * n1 / (n0 + n1)) * ks AS x FROM k), v AS (SELECT *, CASE WHEN x < 0.05 THEN 1 ELSE least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * i * i * x * x))))) END AS p FROM p),
b AS (SELECT *, row_number() OVER (ORDER BY p, s, t) AS i, count(*) OVER () AS n FROM v)
SELECT s AS source_activity, t AS target_activity, n0 AS n_baseline, n1 AS n_current, round(m, 3) AS median_change, round(p95, 3) AS p95_change, round(impact, 2) AS impact_change, round(ks, 9) AS ks, round(p, 9) AS p, round(least(1, min(p * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) AS q FROM b""")  # fmt: skip
def bn_drift(log):
    d = bottlenecks.duration_drift(executions.observations(log, View(end=_t(15))), executions.observations(log, View(start=_t(15)))).drop("object_type")
    return _rounded(_rounded(_rounded(d, "median_change", "p95_change"), "impact_change", digits=2), "ks", "p", "q", digits=9)


_ASKED = [
    {"id": "h1", "cause": "error", "effect": "purchase", "threshold": 7200.0, "most_lag": 86400.0},
    {"id": "h2", "cause": "view", "effect": "click", "effect_source": "error", "threshold": 3600.0, "least_lag": 600.0},
    {"id": "h3", "cause": "signup", "attribute": "resource", "value": "r1", "effect": "view", "threshold": 7200.0, "least_lag": 60.0, "most_lag": 604800.0},
]


def _exposure(h: dict) -> str:
    cause = f"e.activity = '{h['cause']}' AND e.nxt IS NOT NULL" + (f" AND e.{h['attribute']} = '{h['value']}'" if h.get("attribute") else "")
    lag = f" AND epoch_us(x.ts) - epoch_us(e.ts) <= {round(h['most_lag'] * 1e6)}" if h.get("most_lag") else ""
    step = f"nxt = '{h['effect']}'" + (f" AND activity = '{h['effect_source']}'" if h.get("effect_source") else "")
    return f"SELECT '{h['id']}' AS id, {_d()} > {h['threshold']} AS slow, EXISTS (SELECT 1 FROM x e WHERE e.object_id = x.object_id AND {cause} AND epoch_us(x.ts) - epoch_us(e.ts) >= {round(h.get('least_lag', 0) * 1e6)}{lag}) AS exposed FROM x WHERE {step}"


@query(A, f""", e AS ({" UNION ALL ".join(map(_exposure, _ASKED))}), c AS (SELECT id, CAST(count(*) FILTER (exposed AND slow) AS DOUBLE) AS a, CAST(count(*) FILTER (exposed AND NOT slow) AS DOUBLE) AS b, CAST(count(*) FILTER (NOT exposed AND slow) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT exposed AND NOT slow) AS DOUBLE) AS d FROM e GROUP BY 1),
r AS (SELECT *, (a + b) * (c + d) * (a + c) * (b + d) AS base, coalesce(a / nullif(a + b, 0), 0) AS one, coalesce(c / nullif(c + d, 0), 0) AS two FROM c), z AS (SELECT *, CASE WHEN base > 0 THEN (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / base ELSE 0 END AS chi2 FROM r),
p AS (SELECT *, CASE WHEN base > 0 THEN 1 - 2 * sqrt(chi2) / 1536 * (1 + exp(-chi2 / 2) + list_sum(list_transform(range(1, 512), lambda i: (CASE WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-chi2 * i * i / 524288)))) / sqrt(2 * pi()) ELSE 1 END AS p FROM z), k AS (SELECT *, row_number() OVER (ORDER BY p, id) AS i, count(*) OVER () AS n FROM p),
q AS (SELECT *, least(1, min(p * n / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM k)
SELECT id, CAST(a + b AS BIGINT) AS exposed, CAST(a AS BIGINT) AS exposed_slow, CAST(c + d AS BIGINT) AS other, CAST(c AS BIGINT) AS other_slow, round(one - two, 9) AS risk_difference, round(one / nullif(two, 0), 9) AS risk_ratio, round(chi2, 6) AS chi2, round(p, 6) AS p, round(q, 6) AS q, q <= 0.05 AND one > two AND a + b >= 5 AND c + d >= 5 AS supported FROM q""")  # fmt: skip
def bn_hypotheses(log):
    h = bottlenecks.hypotheses(executions.observations(log, keep=["resource"]), _ASKED)
    return _rounded(_rounded(h, "risk_difference", "risk_ratio", digits=9), "chi2", "p", "q", digits=6)


# --- prediction, risk, graphs ---


@query(A, """, h AS (SELECT object_id, pos, activity, nxt, prv FROM x) SELECT key, length, next_activity, count(*) AS n FROM (
SELECT '' AS key, 0 AS length, nxt AS next_activity FROM h UNION ALL SELECT activity, 1, nxt FROM h UNION ALL SELECT prv || '>' || activity, 2, nxt FROM h WHERE prv IS NOT NULL) WHERE next_activity IS NOT NULL GROUP BY 1, 2, 3""")
def prefix_next_counts(log):
    return prediction.fit(_cases(log), order=2)["next"]


@query(A, f""", h AS (SELECT activity, prv, {_d('max(ts) OVER (PARTITION BY object_id)', 'ts')} AS r FROM x), a AS (SELECT '' AS key, 0 AS length, r FROM h UNION ALL SELECT activity, 1, r FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY key, length ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY key, length) AS n FROM a)
SELECT key, length, count(*) AS n, round(avg(r), 3) AS mean, min(r) FILTER (i = round(0.1 * (n - 1))) AS p10, min(r) FILTER (i = round(0.9 * (n - 1))) AS p90 FROM k GROUP BY 1, 2""")
def remaining_time_summary(log):
    return prediction.fit(_cases(log), order=1)["remaining"].withColumn("mean", F.round("mean", 3))


#: Histories of up to three activities, by event, with the next one and the seconds that remain; the earlier seven tenths of cases train.
_HISTORY = f""", h AS (SELECT object_id, event_id, activity AS a0, prv AS a1, lag(activity, 2) OVER (PARTITION BY object_id ORDER BY pos) AS a2, nxt, {_d('max(ts) OVER (PARTITION BY object_id)', 'ts')} AS rest FROM x),
f AS (SELECT object_id, row_number() OVER (ORDER BY max(ts), object_id) <= floor(0.7 * count(*) OVER ()) AS early FROM x GROUP BY 1),
k AS (SELECT object_id, event_id, nxt, rest, early, length, key FROM (SELECT *, 0 AS length, '' AS key FROM h UNION ALL SELECT *, 1, a0 FROM h UNION ALL SELECT *, 2, a1 || '>' || a0 FROM h WHERE a1 IS NOT NULL UNION ALL SELECT *, 3, a2 || '>' || a1 || '>' || a0 FROM h WHERE a2 IS NOT NULL) JOIN f USING (object_id)),
b AS (SELECT key, length, nxt AS prediction, n / sum(n) OVER (PARTITION BY key, length) AS probability, row_number() OVER (PARTITION BY key, length ORDER BY n DESC, nxt) AS r FROM (SELECT key, length, nxt, count(*) AS n FROM k WHERE nxt IS NOT NULL AND TRAIN GROUP BY ALL)),
m AS (SELECT k.*, prediction, probability, row_number() OVER (PARTITION BY event_id ORDER BY length DESC) AS q FROM k JOIN b USING (key, length) WHERE r = 1 AND TEST)"""


@query(A, _HISTORY.replace("TRAIN", "true").replace("TEST", "true") + " SELECT object_id AS execution_id, event_id, length AS matched, prediction, round(probability, 9) AS probability FROM m WHERE q = 1")
def predict_next(log):
    cases = _cases(log)
    return _rounded(prediction.predict(prediction.fit(cases), cases, "next_activity"), "probability", digits=9)


@query(A, _HISTORY.replace("TRAIN", "early").replace("TEST", "NOT early") + " SELECT count(*) AS n, round(avg(CASE WHEN prediction = nxt THEN 1.0 ELSE 0 END), 9) AS score FROM m WHERE q = 1 AND nxt IS NOT NULL")
def holdout_next(log):
    return _rounded(prediction.evaluate(_cases(log), "next_activity"), "score", digits=9)


@query(A, _HISTORY.replace("TRAIN", "early").replace("TEST", "NOT early") + """, i AS (SELECT key, length, rest, row_number() OVER (PARTITION BY key, length ORDER BY rest) - 1 AS i, count(*) OVER (PARTITION BY key, length) AS n FROM k WHERE early),
g AS (SELECT key, length, avg(rest) AS mean, min(rest) FILTER (i = round(0.1 * (n - 1))) AS p10, min(rest) FILTER (i = round(0.9 * (n - 1))) AS p90 FROM i GROUP BY 1, 2),
t AS (SELECT k.rest, mean, p10, p90, row_number() OVER (PARTITION BY event_id ORDER BY length DESC) AS q FROM k JOIN g USING (key, length) WHERE NOT early)
SELECT count(*) AS n, round(avg(abs(mean - rest)), 2) AS score, round(avg(CASE WHEN rest BETWEEN p10 AND p90 THEN 1.0 ELSE 0 END), 9) AS coverage FROM t WHERE q = 1""")
def holdout_remaining(log):
    return _rounded(_rounded(prediction.evaluate(_cases(log), "remaining_time"), "score", digits=2), "coverage", digits=9)


@query(A)
def risk_model(log):
    obs = executions.observations(log)
    return risk.detect(obs, risk.fit(obs))


#: Smallest reachable node of each, by labels that go along edges until none falls.
_LABELS = """, cc AS (WITH RECURSIVE cc(id, comp) USING KEY (id) AS (SELECT id, id FROM nodes UNION (SELECT DISTINCT ON (u.id) u.id, v.comp FROM recurring.cc AS u, edges e, recurring.cc AS v WHERE e.a = u.id AND e.b = v.id AND v.comp < u.comp ORDER BY u.id, v.comp)) SELECT * FROM cc)"""


@query(B, f""", star AS (SELECT object_id AS a, min(object_id) OVER (PARTITION BY event_id) AS b FROM eo UNION SELECT o_orderkey * 4, o_custkey * 4 + 1 FROM orders), edges AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM star UNION ALL SELECT b, a FROM star) WHERE a <> b), nodes AS (SELECT object_id AS id FROM ob)
{_LABELS} SELECT count(DISTINCT comp) AS components, count(*) AS objects, CAST(min(comp) AS BIGINT) AS least FROM cc""")  # fmt: skip
def object_components(log):
    c = executions.components(log, attributes=False)
    return c.select("object_id", "execution_id").distinct().agg(F.count_distinct("execution_id").alias("components"), F.count("*").alias("objects"), F.min("execution_id").alias("least"))


@query(B, f""", own AS (SELECT event_id, object_id FROM eo JOIN ev USING (event_id) WHERE activity = 'ship' AND ((event_id - 1) // 3) % 4000000 % 40 = 0 AND qualifier IN ('order', 'part')),
star AS (SELECT object_id AS a, min(object_id) OVER (PARTITION BY event_id) AS b FROM own), edges AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM star UNION ALL SELECT b, a FROM star) WHERE a <> b), nodes AS (SELECT DISTINCT object_id AS id FROM own)
{_LABELS} SELECT id AS object_id, comp AS execution_id, count(*) OVER (PARTITION BY comp) AS members FROM cc""")  # fmt: skip
def object_components_of_some(log):
    """Of every fortieth part and the orders that it ships in: many components."""
    ship = log.events.filter((F.col("activity") == "ship") & (F.floor((F.col("event_id") - 1) / 3).cast("long") % 4000000 % 40 == 0))
    own = written(log.e2o.join(ship, "event_id", "left_semi").filter("qualifier in ('order', 'part')"))  # read three times
    some = log.having(events=ship, e2o=own, o2o=log.o2o.limit(0))
    return executions.components(some, attributes=False).select("object_id", "execution_id", "members").distinct()


@query(B, """, r AS (SELECT DISTINCT o_orderkey * 4 AS object_id, 0 AS depth FROM orders WHERE o_orderkey = 1), c AS (SELECT DISTINCT o_custkey * 4 + 1 AS object_id, 1 AS depth FROM orders WHERE o_orderkey = 1),
s AS (SELECT DISTINCT o_orderkey * 4 AS object_id, 2 AS depth FROM orders WHERE o_custkey * 4 + 1 IN (SELECT object_id FROM c) AND o_orderkey <> 1) SELECT * FROM r UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s""")
def object_closure(log):
    return closure(log, [4], 2)


# --- sources and sinks: a log written, read back, and counted ---


def _round_trip(log: Log, write: Callable[[Log, str], object], read: Callable[[SparkSession, str], Log], totals: bool = False) -> DataFrame:
    """By activity: events, first_us, last_us, links to objects, r1 (events whose resource is r1), of ``log`` after a way through a
    format; the files, in the folder that the cluster shares, go again."""
    spark = log.events.sparkSession
    folder = re.sub("^file:/*", "/", f"{shared_dir(spark)}/trip-{uuid.uuid4().hex}")
    os.makedirs(folder)
    try:
        write(log, f"{folder}/log")
        back = read(spark, f"{folder}/log")
        links = back.e2o.groupBy("event_id").agg(F.count("*").alias("k"))
        who = F.try_element_at("attributes", F.lit("resource"))["s"]
        e = back.events.join(links, "event_id", "left")
        by = e.groupBy("activity").agg(F.count("*").alias("events"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.sum("k").alias("links"), F.count_if(who == "r1").alias("r1"))
        if totals:
            one = [back.objects.agg(F.count("*").alias("objects")), back.o2o.agg(F.count("*").alias("o2o")), back.object_attrs.agg(F.count("*").alias("changes"))]
            for n in one:
                by = by.join(n, how="cross")  # one number each
        return cut(by)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


_TRIP = "SELECT activity, count(*) AS events, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS links, count(*) FILTER (resource = 'r1') AS r1"
_TRIP_ALL = ", (SELECT count(DISTINCT object_id) FROM x) AS objects, CAST(0 AS BIGINT) AS o2o, (SELECT count(DISTINCT object_id) FROM x) AS changes"


@query(A, f"{_TRIP} FROM x GROUP BY 1")
def io_csv(log):
    return _round_trip(log, lambda g, p: writers.write_csv(g, p, "user"), lambda spark, p: readers.read_csv(spark, p, event_id="event_id", object_type="user"))


@query(A, f"{_TRIP} FROM x GROUP BY 1")
def io_xes(log):
    return _round_trip(log, lambda g, p: writers.write_xes(g, p, "user"), lambda spark, p: readers.read_xes(spark, p, "user"))


@query(A, f"{_TRIP}{_TRIP_ALL} FROM x GROUP BY 1")
def io_ocel_json(log):
    return _round_trip(log, writers.write_ocel_json, readers.read_ocel_json, totals=True)


@query(A, f"{_TRIP}{_TRIP_ALL} FROM x GROUP BY 1")
def io_canonical_json(log):
    return _round_trip(log, writers.write_canonical_json, readers.read_canonical_json, totals=True)


@query(A, f"{_TRIP.replace('(resource', '(false AND resource')} FROM x GROUP BY 1")
def io_sqlite(log):
    """The compact dialect holds no attributes."""
    return _round_trip(log, writers.write_sqlite, readers.read_sqlite)


@query(B, """SELECT activity, count(DISTINCT event_id) AS events, CAST(epoch_us(min(ts)) AS BIGINT) AS first_us, CAST(epoch_us(max(ts)) AS BIGINT) AS last_us, count(*) AS links, CAST(0 AS BIGINT) AS r1,
(SELECT count(*) FROM ob) AS objects, (SELECT count(*) FROM orders) AS o2o, (SELECT 3 * count(*) FROM orders) AS changes FROM ev JOIN eo USING (event_id) GROUP BY 1""")  # fmt: skip
def io_snapshot(log):
    """A version that CURRENT names, read with all checks, hashes too."""
    return _round_trip(log, lambda g, p: writers.write_snapshot(g, p, "v1"), lambda spark, p: readers.read_snapshot(spark, p, readers.Selection("current"), "strict"), totals=True)


def _write_links(log: Log, path: str) -> None:
    """The four files of linked entities, out of users: a case for each, whose list names its events in order."""
    met = log.e2o.join(log.events, "event_id").join(log.objects, "object_id")
    mine = F.lit("t1").alias("tenant_id")
    order = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda e: e["event_id"])
    parts = {
        "case_event_group": met.groupBy("object_id").agg(F.min("ts").alias("timestamp"), order.alias("system_note_ids")).select(mine, F.col("object_id").alias("case_id"), "timestamp", "system_note_ids", F.lit(0).cast("long").alias("time_rank")),
        "event_log": met.select(mine, F.col("object_id").alias("case_id"), F.col("ts").alias("timestamp"), F.col("activity").alias("activity_id"), "object_type", F.to_json(F.struct(F.col("event_id").alias("id"))).alias("display"), "object_id"),
        "txn": log.objects.select(mine, F.col("object_id").alias("id"), F.lit("user").alias("type"), F.when(F.col("object_id") % 2 == 0, "Y").otherwise("N").alias("status")),
        "object_link": log.o2o.select(mine, "source_object_id", "target_object_id", F.col("valid_from").alias("timestamps")),
    }
    for name, df in parts.items():
        df.union(df.withColumn("tenant_id", F.lit("t2")).limit(3)).write.parquet(f"{path}/{name}.parquet")


@query(A, f"""{_TRIP.replace('count(*) AS links', '2 * count(*) AS links').replace('(resource', '(false AND resource')}, 2 * (SELECT count(DISTINCT object_id) FROM x) AS objects, CAST(0 AS BIGINT) AS o2o,
(SELECT count(*) + count(*) FILTER (object_id % 2 = 1) FROM (SELECT DISTINCT object_id FROM x)) AS changes FROM x GROUP BY 1""")  # fmt: skip
def io_entity_links(log):
    """Each event is linked to its object and to its case; types are facts of all, the status Y of none."""
    return _round_trip(log, _write_links, lambda spark, p: readers.read_entity_links(spark, p, "t1"), totals=True)


def _write_serving(log: Log, path: str) -> None:
    files = {}
    facets = log.objects.select("object_id", F.lit("gold").alias("tier"), F.when(F.col("object_id") % 3 == 0, "").otherwise("x").alias("mark"))
    for name, df in (log.relations() | {"object_attrs": facets}).items():
        df.write.parquet(f"{path}/{name}")
        files[name] = {"path": name, "rows": df.count()}
    with open(f"{path}/manifest.json", "w") as f:
        f.write(canonical_json({"files": files}))


@query(A, f"{_TRIP}, (SELECT count(DISTINCT object_id) FROM x) AS objects, CAST(0 AS BIGINT) AS o2o, (SELECT count(*) + count(*) FILTER (object_id % 3 <> 0) FROM (SELECT DISTINCT object_id FROM x)) AS changes FROM x GROUP BY 1")
def io_serving(log):
    """Facets, a column each, become attribute changes where they are not blank."""
    return _round_trip(log, _write_serving, readers.read_serving, totals=True)


@query(A, "SELECT activity, object_id, CAST(pos AS INTEGER) AS pos, CAST(epoch_us(ts) AS BIGINT) AS us FROM x WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'")
def event_export(log):
    """The rows of a window, numbered in their case of the whole log."""
    c = _cases(log).filter((F.col("ts") >= F.lit(_t(5))) & (F.col("ts") < F.lit(_t(20))))
    return c.select("activity", "object_id", "pos", F.unix_micros("ts").alias("us"))


@query(A, """, e AS (SELECT activity, nxt FROM x WHERE nxt IS NOT NULL) SELECT activity AS source, nxt AS target, count(*) AS frequency FROM e GROUP BY 1, 2""")
def incremental_summary(log):
    """Of three batches of whole cases."""
    s = Summary()
    for k in range(3):
        own = log.objects.filter(F.pmod(F.xxhash64("object_id"), F.lit(3)) == k)
        links = log.e2o.join(own, "object_id", "left_semi")
        s.add(log.having(objects=own, e2o=links, events=log.events.join(links, "event_id", "left_semi")))
    return s.result().select("source", "target", "frequency")


@query(A, "SELECT activity, count(*) AS events, count(DISTINCT object_id) AS objects FROM x GROUP BY 1")
def appended_log(log):
    """The first half of a month, to which the second is appended."""
    late = F.col("ts") >= F.lit(_t(15))
    rest = log.events.filter(late)
    first = log.having(events=log.events.filter(~late), e2o=log.e2o.join(rest, "event_id", "left_anti"), watermark=_t(14))
    whole = append(first, {"events": rest, "e2o": log.e2o.join(rest, "event_id", "left_semi")}, _t(30))
    return whole.e2o.join(whole.events, "event_id").groupBy("activity").agg(F.count_distinct("event_id").alias("events"), F.count_distinct("object_id").alias("objects"))
