"""Constraint queries: a tree of conditions becomes one aggregate over executions and one boolean expression over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.model import EngineError, Log, View
from tracelake.operators.executions import attributes_as_of, in_case, leading, ordered, same_value

LIMIT, DEPTH = 100_000, 64
_LISTS = {"event_id": "ids", "object_id": "ids", "event_activity": "activities", "object_type": "types", "e2o_qualifier": "qualifiers", "o2o_qualifier": "qualifiers", "and": "children", "or": "children"}


def check(c: dict, depth: int = 1) -> None:
    """Depth, known kinds, and lists that are not empty."""
    if depth > DEPTH:
        raise EngineError("invalid_request", f"deeper than {DEPTH}")
    kind = c.get("kind")
    known = {*_LISTS, "event_attribute", "object_attribute", "directly_follows", "eventually_follows", "temporal_distance", "relationship", "child_count", "not", "label"}
    if kind not in known:
        raise EngineError("invalid_request", f"no such constraint: {kind}")
    if kind in _LISTS and not c.get(_LISTS[kind]):
        raise EngineError("invalid_request", f"{kind} needs {_LISTS[kind]}")
    for child in [*c.get("children", []), *([c["child"]] if "child" in c else [])]:
        check(child, depth + 1)


class _Compiler:
    """Collects aggregates (name -> column over a case's events) and joins; ``test`` gives an expression over these."""

    def __init__(self, log: Log) -> None:
        self.log, self.sums, self.joins, self.labels = log, {}, [], []
        self.before: list[tuple[DataFrame, list[str]]] = []  # joins of events, ahead of the aggregate, and their keys

    def sum(self, column: Column) -> Column:
        name = f"a{len(self.sums)}"
        self.sums[name] = column
        return F.col(name)

    def any(self, column: Column) -> Column:
        return F.coalesce(self.sum(F.bool_or(column)), F.lit(False))

    def flag(self, ids: DataFrame) -> Column:
        """Whether the execution's object is in ``ids`` (execution_id)."""
        name = f"j{len(self.joins)}"
        self.joins.append(ids.distinct().withColumn(name, F.lit(True)))
        return F.coalesce(F.col(name), F.lit(False))

    def mark(self, rows: DataFrame, keys: list[str]) -> Column:
        """Whether an event's ``keys`` are in ``rows``."""
        name = f"b{len(self.before)}"
        self.before.append((rows.select(*keys).distinct().withColumn(name, F.lit(True)), keys))
        return F.coalesce(F.col(name), F.lit(False))

    def own_links(self, c: dict) -> DataFrame:
        """Links of objects to themselves, the only ones with both ends in an execution of one object."""
        own = self.log.o2o.filter(F.col("source_object_id") == F.col("target_object_id"))
        if c.get("qualifiers") is not None:
            own = own.filter(F.col("qualifier").isin(c["qualifiers"]))
        if c.get("qualifier") is not None:
            own = own.filter(F.col("qualifier") == c["qualifier"])
        return own.select(F.col("source_object_id").alias("object_id"))

    def on_event(self, c: dict) -> Column:
        """The constraint on one event as an execution of its own; what needs two events is false there."""
        k = c["kind"]
        if k == "event_id":
            return F.col("event_id").isin(c["ids"])
        if k == "event_activity":
            return F.col("activity").isin(c["activities"])
        if k == "event_attribute":
            return same_value(F.try_element_at("attributes", F.lit(c["name"])), c["value"])
        if k == "object_id":
            return F.col("object_id").isin(c["ids"])
        if k == "object_type":
            return F.col("object_type").isin(c["types"])
        if k in ("directly_follows", "eventually_follows", "temporal_distance"):
            return F.lit(False)
        if k == "e2o_qualifier":
            return self.mark(self.log.e2o.filter(F.col("qualifier").isin(c["qualifiers"])), ["event_id", "object_id"])
        if k == "o2o_qualifier":
            return self.mark(self.own_links(c), ["object_id"])
        if k == "relationship":
            return self.mark(self.own_links(c), ["object_id"]) & (F.col("object_type") == c["source_type"]) & F.lit(c["source_type"] == c["target_type"])
        if k == "object_attribute":  # as of the event, strictly before
            name = f"b{len(self.before)}"
            changes = self.log.object_attrs.filter(F.col("name") == c["name"]).groupBy("object_id").agg(F.collect_list(F.struct("valid_from", "value")).alias(name))
            self.before.append((changes, ["object_id"]))
            return F.coalesce(same_value(F.array_max(F.filter(name, lambda x: x["valid_from"] < F.col("ts")))["value"], c["value"]), F.lit(False))
        if k == "child_count":  # of one event, that is one or none
            n = self.on_event(c["child"]).cast("int")
            return (n >= c.get("min", 0)) & (n <= c["max"] if c.get("max") is not None else F.lit(True))
        if k in ("and", "or"):
            out = self.on_event(c["children"][0])
            for x in c["children"][1:]:
                out = out & self.on_event(x) if k == "and" else out | self.on_event(x)
            return out
        if k == "not":
            return ~self.on_event(c["child"])
        if k == "label":
            return self.on_event(c["child"])
        raise EngineError("invalid_request", f"no such constraint: {k}")

    def test(self, c: dict, reached: Column) -> Column:
        """reached: whether evaluation from left to right, ending as soon as the outcome is known, gets here. Labels need it."""
        k = c["kind"]
        if k in ("event_id", "event_activity", "event_attribute"):
            return self.any(self.on_event(c))
        if k == "object_id":
            return F.col("object_id").isin(c["ids"])
        if k == "object_type":
            return F.col("object_type").isin(c["types"])
        if k == "object_attribute":
            last = self.sum(F.max("ts"))  # as of the last event, strictly before
            changes = self.log.object_attrs.filter(F.col("name") == c["name"]).groupBy(F.col("object_id").alias("execution_id")).agg(F.collect_list(F.struct("valid_from", "value")).alias(n := f"h{len(self.joins)}"))
            self.joins.append(changes)
            before = F.array_max(F.filter(F.col(n), lambda x: x["valid_from"] < last))
            return F.coalesce(same_value(before["value"], c["value"]), F.lit(False))
        if k == "e2o_qualifier":
            return self.flag(self.log.e2o.filter(F.col("qualifier").isin(c["qualifiers"])).select(F.col("object_id").alias("execution_id")))
        if k == "o2o_qualifier":
            return self.flag(self.own_links(c).withColumnRenamed("object_id", "execution_id"))
        if k == "relationship":
            return self.flag(self.own_links(c).withColumnRenamed("object_id", "execution_id")) & (F.col("object_type") == c["source_type"]) & F.lit(c["source_type"] == c["target_type"])
        if k == "directly_follows":
            return self.any((F.col("activity") == c["a"]) & (F.col("next_activity") == c["b"]))
        if k == "eventually_follows":
            first, last = self.sum(F.min(F.when(F.col("activity") == c["a"], F.col("pos")))), self.sum(F.max(F.when(F.col("activity") == c["b"], F.col("pos"))))
            return F.coalesce(first < last, F.lit(False))
        if k == "temporal_distance":
            at = lambda a: self.sum(F.collect_list(F.when(F.col("activity") == a, F.struct("pos", F.unix_micros("ts").alias("us")))))
            a, b = at(c["a"]), at(c["b"])
            lo, hi = round((c.get("min") or 0) * 1e6), c.get("max")
            # each b, moved back by the least distance, against the last a that is not after it: no pairs are made
            first = lambda x, kind: x["pos"] if lo <= 0 else F.lit(kind).cast("int")
            mark = lambda x, kind, by: F.struct((x["us"] - by).alias("t"), first(x, kind).alias("p"), F.lit(kind).alias("kind"), x["us"].alias("us"))
            walk = F.array_sort(F.concat(F.transform(a, lambda x: mark(x, 0, 0)), F.transform(b, lambda y: mark(y, 1, max(lo, 0)))))
            near = lambda s, x: s["last"].isNotNull() if hi is None else F.coalesce(x["us"] - s["last"] <= round(hi * 1e6), F.lit(False))
            step = lambda s, x: F.struct(F.when(x["kind"] == 0, x["us"]).otherwise(s["last"]).alias("last"), (s["ok"] | ((x["kind"] == 1) & near(s, x))).alias("ok"))
            return F.aggregate(walk, F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("ok")), step, lambda s: s["ok"])
        if k == "child_count":
            n = self.sum(F.count_if(self.on_event(c["child"])))
            out = n >= c.get("min", 0)
            return out & (n <= c["max"]) if c.get("max") is not None else out
        if k in ("and", "or"):
            out = None
            for child in c["children"]:
                here = self.test(child, reached)
                out = here if out is None else out & here if k == "and" else out | here
                reached = reached & (here if k == "and" else ~here)
            return out
        if k == "not":
            return ~self.test(c["child"], reached)
        if k == "label":
            out = self.test(c["child"], reached)
            self.labels.append(F.when(reached & out, F.lit(c["name"])))
            return out
        raise EngineError("invalid_request", f"no such constraint: {k}")


def matches(log: Log, constraint: dict, view: View = View(), object_type: str | None = None) -> DataFrame:
    """execution_id, object_id, object_type, external_object_id, event_ids, labels of each leading execution that fits.

    One shuffle by execution, whatever the size of the tree; labels of failed branches stay, as evaluation reached them."""
    check(constraint)
    cases = ordered(leading(log, view, object_type))
    to = _Compiler(log)
    fits = to.test(constraint, F.lit(True))
    for rows, on in to.before:
        cases = cases.join(rows, on, "left")
    keys = ["execution_id", "object_id", "object_type", "external_object_id"]
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id"))), lambda x: x["event_id"])
    out = cases.groupBy(*keys).agg(ids.alias("event_ids"), *[c.alias(n) for n, c in to.sums.items()])
    for j in to.joins:
        out = out.join(j, "execution_id", "left")
    labels = F.array_compact(F.array(*to.labels)) if to.labels else F.array().cast("array<string>")
    return out.filter(fits).select(*keys, "event_ids", labels.alias("labels"))


def query(log: Log, request: dict) -> dict:
    """bindings, total_matches and truncated, after counting all; ordered by type and external id."""
    limit = request.get("limit", LIMIT)
    if limit <= 0:
        raise EngineError("invalid_request", "limit is positive")
    found = matches(log, request["constraint"], View.parse(request.get("view")), request.get("object_type"))
    total = found.count()
    rows = found.orderBy("object_type", "external_object_id").limit(limit).collect()
    return {"bindings": [{"event_ids": r["event_ids"], "object_ids": [r["object_id"]], "labels": r["labels"], "violated": False} for r in rows], "total_matches": total, "truncated": total > limit}


# Binding operators: (ids, violated or value) as plain columns. What they mean is stated here, as their names suggest it.


def object_activity_count(log: Log, object_type: str, activity: str, least: int, most: int) -> DataFrame:
    """object_id, n, violated: whether an object has the activity not between least and most times."""
    objects = log.objects.filter(F.col("object_type") == object_type).select("object_id")
    hits = log.e2o.select("event_id", "object_id").distinct().join(log.events.filter(F.col("activity") == activity).select("event_id"), "event_id")
    n = objects.join(hits.groupBy("object_id").agg(F.count("*").alias("n")), "object_id", "left").select("object_id", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("violated", ~F.col("n").between(least, most))


def requires_activity(log: Log, object_type: str, source: str, required: str) -> DataFrame:
    """object_id, violated: for objects with ``source``, whether ``required`` is missing."""
    cases = leading(log, View(object_types=(object_type,)), attributes=False)
    by = cases.groupBy("object_id").agg(F.bool_or(F.col("activity") == source).alias("has"), F.bool_or(F.col("activity") == required).alias("met"))
    return by.filter("has").select("object_id", (~F.col("met")).alias("violated"))


def event_object_count(log: Log, object_type: str, activity: str, least: int, most: int) -> DataFrame:
    """event_id, n, violated: whether events of the activity have not between least and most objects of the type."""
    events = log.events.filter(F.col("activity") == activity).select("event_id")
    own = log.e2o.join(log.objects.filter(F.col("object_type") == object_type), "object_id", "left_semi")
    n = events.join(own.groupBy("event_id").agg(F.count_distinct("object_id").alias("n")), "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"))
    return n.withColumn("violated", ~F.col("n").between(least, most))


def neighbours(log: Log, source_type: str, target_type: str) -> DataFrame:
    """source, target: objects of the two types that an O2O link (either way) or a common event ties."""
    s = log.objects.filter(F.col("object_type") == source_type).select(F.col("object_id").alias("source"))
    t = log.objects.filter(F.col("object_type") == target_type).select(F.col("object_id").alias("target"))
    both = log.o2o.select(F.col("source_object_id").alias("source"), F.col("target_object_id").alias("target")).union(log.o2o.select("target_object_id", "source_object_id"))
    a = log.e2o.select("event_id", F.col("object_id").alias("source")).join(s, "source", "left_semi")
    b = log.e2o.select("event_id", F.col("object_id").alias("target")).join(t, "target", "left_semi")
    linked = both.join(s, "source", "left_semi").join(t, "target", "left_semi")
    return linked.select("source", "target").union(a.join(b, "event_id").select("source", "target")).filter("source != target").distinct()


def _times(log: Log, object_type: str, activity: str, name: str) -> DataFrame:
    cases = leading(log, View(object_types=(object_type,), activities=(activity,)), attributes=False)
    return cases.groupBy(F.col("object_id").alias(name)).agg(F.min("ts").alias(f"{name}_first"), F.max("ts").alias(f"{name}_last"))


def neighbor_eventually(log: Log, source_type: str, source_activity: str, target_type: str, target_activity: str) -> DataFrame:
    """source, violated: whether, for a source with its activity, no neighbour has the target activity later."""
    met = _times(log, source_type, source_activity, "source").join(neighbours(log, source_type, target_type), "source", "left").join(_times(log, target_type, target_activity, "target"), "target", "left")
    return met.groupBy("source").agg(F.max(F.coalesce(F.col("target_last") > F.col("source_first"), F.lit(False))).alias("ok")).select("source", (~F.col("ok")).alias("violated"))


def neighbor_attribute_equal(log: Log, source_type: str, target_type: str, name: str) -> DataFrame:
    """source, target, violated: whether neighbours differ in the latest value of an object attribute (both missing is equal)."""
    now = attributes_as_of(log).filter(F.col("name") == name).select("object_id", "value")
    met = neighbours(log, source_type, target_type).join(now.withColumnsRenamed({"object_id": "source", "value": "sv"}), "source", "left").join(now.withColumnsRenamed({"object_id": "target", "value": "tv"}), "target", "left")
    return met.select("source", "target", (~F.col("sv").eqNullSafe(F.col("tv"))).alias("violated"))


def neighbor_actor_equal(log: Log, source_type: str, target_type: str, attribute: str = "resource") -> DataFrame:
    """source, target, violated: whether the actors of neighbours' first events differ."""
    first = leading(log, View()).groupBy("object_id").agg(F.min_by(F.try_element_at("attributes", F.lit(attribute))["s"], F.struct("ts", "seq", "external_event_id")).alias("actor"))
    met = neighbours(log, source_type, target_type).join(first.withColumnsRenamed({"object_id": "source", "actor": "sa"}), "source", "left").join(first.withColumnsRenamed({"object_id": "target", "actor": "ta"}), "target", "left")
    return met.select("source", "target", (~F.col("sa").eqNullSafe(F.col("ta"))).alias("violated"))


def max_activity_delay(log: Log, object_type: str, source: str, target: str) -> DataFrame:
    """value: the longest time in seconds from an object's first ``source`` to its last ``target`` event."""
    cases = leading(log, View(object_types=(object_type,)), attributes=False)
    by = cases.groupBy("object_id").agg(F.min(F.when(F.col("activity") == source, F.col("ts"))).alias("a"), F.max(F.when(F.col("activity") == target, F.col("ts"))).alias("b"))
    return by.agg(F.max((F.unix_micros("b") - F.unix_micros("a")) / 1e6).alias("value"))


def neighbor_pairs(log: Log, source_type: str, target_type: str) -> DataFrame:
    """source, targets: each source with its neighbours, not multiplied out (explode twice for pairs of these)."""
    return neighbours(log, source_type, target_type).groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def relation_universal_equal(log: Log, source_type: str, target_type: str, related_type: str) -> DataFrame:
    """source, violated: whether a neighbour relates to an object of the related type that the source does not relate to."""
    own = neighbours(log, source_type, related_type).withColumnRenamed("target", "related")
    theirs = neighbours(log, source_type, target_type).join(neighbours(log, target_type, related_type).toDF("target", "related"), "target").select("source", "related").distinct()
    met = theirs.join(own.withColumn("same", F.lit(True)), ["source", "related"], "left")
    return met.groupBy("source").agg(F.max(F.col("same").isNull()).alias("violated"))


def event_pairs(log: Log, object_type: str, source: str, target: str) -> DataFrame:
    """object_id, source_event, target_event: an object's events of two activities, each source with the next target after it."""
    cases = leading(log, View(object_types=(object_type,), activities=(source, target)), attributes=False)
    after = F.first(F.when(F.col("activity") == target, F.col("event_id")), ignorenulls=True).over(in_case().rowsBetween(1, Window.unboundedFollowing))
    return cases.withColumn("target_event", after).filter((F.col("activity") == source) & F.col("target_event").isNotNull()).select("object_id", F.col("event_id").alias("source_event"), "target_event")


def relation_children(log: Log, source_type: str, target_type: str, qualifier: str | None = None) -> DataFrame:
    """source, n: how many objects of the target type an object of the source type links to."""
    of = lambda t, name: log.objects.filter(F.col("object_type") == t).select(F.col("object_id").alias(name))
    links_ = log.o2o if qualifier is None else log.o2o.filter(F.col("qualifier") == qualifier)
    own = links_.select(F.col("source_object_id").alias("source"), F.col("target_object_id").alias("target")).join(of(target_type, "target"), "target", "left_semi")
    by = own.groupBy("source").agg(F.count_distinct("target").alias("n"))
    return of(source_type, "source").join(by, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


def related_types(log: Log) -> DataFrame:
    """execution_id (an object), object_type: the types of other objects that share an event with it or are linked to it. Types
    of an event are few: its objects meet these, not each other."""
    named = log.e2o.select("event_id", "object_id").distinct().join(log.objects.select("object_id", "object_type"), "object_id")
    of_event = named.groupBy("event_id", F.col("object_type").alias("other")).agg(F.count("*").alias("k"))
    shared = named.join(of_event, "event_id").filter("other != object_type or k > 1").select(F.col("object_id").alias("execution_id"), F.col("other").alias("object_type"))
    both = log.o2o.select(F.col("source_object_id").alias("execution_id"), F.col("target_object_id").alias("object_id")).union(log.o2o.select("target_object_id", "source_object_id")).filter("execution_id != object_id")
    return shared.union(both.join(log.objects.select("object_id", "object_type"), "object_id").select("execution_id", "object_type")).distinct()


BINDINGS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (object_activity_count, requires_activity, event_object_count, neighbor_eventually, neighbor_attribute_equal, neighbor_actor_equal, max_activity_delay, neighbor_pairs, relation_universal_equal, event_pairs, relation_children)
}


def prepare(log: Log, tree: dict) -> dict[str, DataFrame]:
    """The bindings of a tree, root first: a node is {operator, arguments, name (else its operator and place), children}. All of
    a tree are one dict of DataFrames; nothing runs before one of them is asked for."""
    out: dict[str, DataFrame] = {}

    def walk(node: dict, depth: int) -> None:
        if depth > 64:
            raise EngineError("resource_limit", "a tree deeper than 64")
        if node.get("operator") not in BINDINGS:
            raise EngineError("invalid_request", f"binding operators are {sorted(BINDINGS)}")
        name = node.get("name") or f"{node['operator']}_{len(out)}"
        if name in out:
            raise EngineError("invalid_request", f"two bindings are named {name}")
        out[name] = BINDINGS[node["operator"]](log, **node.get("arguments", {}))
        for child in node.get("children", ()):
            walk(child, depth + 1)

    walk(tree, 0)
    return out
