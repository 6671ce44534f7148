"""Goldens of single operators on logs made by hand, formats that come back as they went, and errors."""

import json
import random
import sqlite3
from collections import deque
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tracelake import model
from tracelake.engine import Engine
from tracelake.model import EngineError, Log, View
from tracelake.operators import bottlenecks, conformance, constraints, discovery, enhancement, executions, kernels, prediction, risk, stats
from tracelake.sources import readers, writers
from tracelake.streaming.append import Summary, append, pairs_by_case, running_graph, windowed_counts

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
NONE = F.lit  # columns are made with a session


def make(spark, cases, kind="order", gap=1.0, resources=False):
    """A log of one object for each case: {object_id: "abc" or [(activity, seconds, lifecycle, resource)]}."""
    events, e2o, n = [], [], 0
    for o, path in cases.items():
        for k, step in enumerate(path):
            a, s, life, who = step if isinstance(step, tuple) else (step, k * gap, None, None)
            n += 1
            ts = T0 + timedelta(seconds=s)
            attrs = {"status": ("string", "open" if k == 0 else "closed", None, None, None, None)}
            if who:
                attrs["resource"] = ("string", who, None, None, None, None)
            events.append((n, f"e{n:06d}", a, ts, None, None, n, life, attrs))
            e2o.append((n, n, o, "case"))
    f = spark.createDataFrame
    objects = f([(o, f"o{o:04d}", kind) for o in cases], model.OBJECTS)
    return Log(f(events, model.EVENTS), objects, f(e2o, model.E2O), f([], model.O2O), f([], model.OBJECT_ATTRS))


def cases_of(log, **view):
    return executions.ordered(executions.leading(log, View(**view)))


def counts(df, *keys, n="frequency"):
    return {tuple(r[k] for k in keys): r[n] for r in df.collect()}


def test_graph_and_profile(spark):
    c = cases_of(make(spark, {1: "ABA", 2: "ABA", 3: "C"}))
    assert counts(stats.dfg(c), "source", "target") == {("A", "B"): 2, ("B", "A"): 2}
    p = {r["activity"]: r.asDict() for r in stats.activity_profile(c).collect()}
    assert p["A"] == {"activity": "A", "cases": 2, "occurrences": 4, "starts": 2, "ends": 2}
    assert counts(stats.variants(c), "path") == {("A>B>A",): 2, ("C",): 1}


def test_count_kernels(spark):
    f = spark.createDataFrame
    rows = f([("A", "B", 80, 8), ("B", "C", 15, 1), ("B", "D", 5, 1)], "source string, target string, train long, test long")
    got = kernels.frequency_conformance(rows, ["source", "target"], 0.95).first().asDict()
    assert (got["conforming"], got["deviations"], got["model_size"], got["fitness"]) == (9, 1, 2, 0.9)
    empty = f([("v", 1, 0)], "v string, train long, test long")
    assert kernels.frequency_conformance(empty, ["v"], 0.95).first()["fitness"] == 1.0
    tie = f([("A", "C", 10, 3), ("A", "B", 10, 7)], "source string, target string, train long, test long")
    assert kernels.score_next(tie).first()["correct"] == 7
    unseen = f([("A", "B", 10, 0), ("Z", "Y", 0, 5)], "source string, target string, train long, test long")
    assert tuple(kernels.score_next(unseen).first())[:2] == (0, 5)
    total, top = kernels.frequency_drift(f([("A", 5, 0), ("A", 5, 0), ("B", 0, 10)], "label string, baseline long, current long"), "label")
    assert total.first()[0] == pytest.approx(1.0) and {r["label"]: r["contribution"] for r in top.collect()}["A"] == pytest.approx(0.5)
    order = f([(0, 10, 2.0), (1, 20, 2.0), (2, 30, 1.0)], "i int, frequency long, mean_seconds double")
    assert [r["i"] for r in kernels.bottleneck_order(order, "i").orderBy("rank").collect()] == [1, 0, 2]


def test_view_is_half_open_and_typed(spark):
    log = make(spark, {1: "abc"})
    assert executions.event_filter(log.events, View(start=T0, end=T0 + timedelta(seconds=2))).count() == 2
    assert executions.event_filter(log.events, View(statuses=("closed",))).count() == 2
    assert executions.event_filter(log.events, View(event_attributes={"status": "open"})).count() == 1
    assert executions.event_filter(log.events, View(event_attributes={"status": 1})).count() == 0
    with pytest.raises(EngineError):
        View.parse({"no_such": 1})


def test_links_by_validity_and_attributes_as_of(spark):
    f = spark.createDataFrame
    at = lambda s: T0 + timedelta(seconds=s)
    log = make(spark, {1: "a", 2: "b"})
    o2o = f([(1, 1, 2, "q", at(0), at(1)), (2, 1, 2, "q", at(2), at(3)), (3, 1, 2, "q", at(0), at(3))], model.O2O)
    v = lambda s: ("string", s, None, None, None, None)
    attrs = f([(1, "n", at(0), v("before")), (1, "n", at(2), v("after"))], model.OBJECT_ATTRS)
    s = executions.snapshot(log.having(o2o=o2o, object_attrs=attrs), View(start=at(1), end=at(2)))
    assert [r["relation_id"] for r in s.o2o.collect()] == [3]
    assert executions.attributes_as_of(log.having(object_attrs=attrs), at(2)).first()["value"]["s"] == "before"


def test_constraints_and_labels(spark):
    log = make(spark, {1: "abc", 2: "acb", 3: "c"})
    q = lambda c, **k: sorted(r["execution_id"] for r in constraints.matches(log, c, **k).collect())
    assert q({"kind": "directly_follows", "a": "a", "b": "b"}) == [1]
    assert q({"kind": "eventually_follows", "a": "a", "b": "b"}) == [1, 2]
    assert q({"kind": "temporal_distance", "a": "a", "b": "b", "min": 1.5}) == [2]
    assert q({"kind": "not", "child": {"kind": "event_activity", "activities": ["a"]}}) == [3]
    # inside child_count an order of two events is never met
    assert q({"kind": "child_count", "child": {"kind": "directly_follows", "a": "a", "b": "b"}, "min": 1}) == []
    label = lambda n, c: {"kind": "label", "name": n, "child": c}
    has = lambda a: {"kind": "event_activity", "activities": [a]}
    tree = {"kind": "or", "children": [{"kind": "and", "children": [label("c", has("c")), has("x")]}, label("a", has("a")), label("b", has("b"))]}
    got = {r["execution_id"]: r["labels"] for r in constraints.matches(log, tree).collect()}
    assert got == {1: ["c", "a"], 2: ["c", "a"]}
    r = constraints.query(log, {"constraint": has("c"), "limit": 2})
    assert (r["total_matches"], r["truncated"], len(r["bindings"])) == (3, True, 2)
    deep = has("a")
    for _ in range(70):
        deep = {"kind": "not", "child": deep}
    with pytest.raises(EngineError):
        constraints.check(deep)


def test_discovery(spark):
    c = cases_of(make(spark, {1: "abcd", 2: "acbd", 3: "aed"}))
    net = discovery.alpha(c)
    arcs = {(a, b) for a, b in net["arcs"]}
    assert ("source", "t:a") in arcs and ("t:d", "sink") in arcs and len(net["places"]) == 6
    tree = discovery.process_tree(c)["root"]
    assert tree["op"] == "sequence" and tree["children"][0]["label"] == "a"
    # some tails are empty: a branch, not a crash
    assert discovery.process_tree(cases_of(make(spark, {1: "ab", 2: "a", 3: "ac"})))["root"]["children"][1]["op"] == "xor"
    tree_of = lambda *ts: discovery._tree(Counter(tuple(t) for t in ts))
    flat = lambda t: t.get("label") or f"{t['op']}({','.join(flat(x) for x in t.get('children', []))})"
    assert flat(tree_of("aa", "a")) == "a" and flat(tree_of("ab", "ba")) == "parallel(a,b)" and flat(tree_of("ab", "cd")) == "xor(sequence(a,b),sequence(c,d))"
    assert flat(tree_of("abd", "bce", "ae")) == "sequence(a,b,c,d,e)" and flat(tree_of("abca", "bcab", "cabc")) == "loop(a,sequence(b,c,a))"
    a = discovery.discover(c, "object_centric_dfg")
    assert a["algorithm"] == "ocdfg" and a["hash"] == discovery.discover(c, "oc_dfg")["hash"]
    model.check_artifact(a)
    with pytest.raises(EngineError):
        model.check_artifact(a | {"model": {}})


def test_conformance(spark):
    c = cases_of(make(spark, {1: "abd", 2: "acd", 3: "ad"}))
    g = discovery.graph(cases_of(make(spark, {1: "abd", 2: "acd"})))
    f = conformance.frequency_coverage(c, g).first()
    assert (f["steps"], f["conforming"], f["violating_executions"]) == (5, 4, 1)
    cost = {r["path"]: r["cost"] for r in conformance.alignment(c, g).collect()}
    assert cost == {"a>b>d": 0, "a>c>d": 0, "a>d": 1}
    net = discovery.alpha(cases_of(make(spark, {1: "abd", 2: "acd"})))
    got = {r["path"]: r["fitness"] for r in conformance.token_replay(c, net).collect()}
    assert got["a>b>d"] == 1.0 and got["a>d"] < 1.0
    rules = [{"template": t, "a": "a", "b": "b"} for t in ("response", "precedence", "coexistence", "exclusive_choice")]
    assert {r["template"]: r["holds"] for r in conformance.check_declare(c, rules).collect()} == {"response": 1, "precedence": 3, "coexistence": 1, "exclusive_choice": 2}


def test_alignment_is_cheapest():
    g = {"type": "dfg", "edges": [["a", "b", 1], ["b", "c", 1], ["a", "c", 1]], "starts": {"a": 1}, "ends": {"c": 1}}
    assert conformance.align_trace(g, list("abc"))[0] == 0
    assert conformance.align_trace(g, list("axc"))[0] == 1
    assert conformance.align_trace(g, [])[0] == 2


def test_fifo_pairs_match_a_queue(spark):
    r = random.Random(3)
    rows, want = [], []
    for k in range(60):
        queue: deque = deque()
        for i in range(r.randint(1, 25)):
            way = r.choice((1, -1))
            rows.append((k, way, T0 + timedelta(seconds=i), k * 100 + i))
            if way == 1:
                queue.append(k * 100 + i)
            elif queue:
                want.append((queue.popleft(), k * 100 + i))
    df = spark.createDataFrame(rows, "k int, way int, ts timestamp, event_id long")
    got = sorted((x["event_id"], x["c_event_id"]) for x in enhancement.fifo_pairs(df, ["k"], ["ts", "event_id"]).collect())
    assert got == sorted(want)


def test_bottleneck_parts(spark):
    assert bottlenecks.inversions([1, 3, 2, 0]) == 4 and bottlenecks.inversions([1, 1, 2]) == 0
    q = bottlenecks.adjust([0.01, 0.03, 0.2])
    assert q == sorted(q) and max(q) <= 1
    steps = {i: [("a", 0, None, None), ("b", 20, None, None)] for i in range(10)} | {20 + i: [("x", 0, None, None), ("y", 1000 if i == 4 else 1, None, None)] for i in range(5)}
    s = bottlenecks.ranked(bottlenecks.signals(executions.observations(make(spark, steps)), threshold=5.0)).collect()
    assert s[0]["source_activity"] == "x" and s[0]["impact"] == pytest.approx(995) and s[1]["impact"] == pytest.approx(150)


def test_waiting_sums_up(spark):
    work = {o: [("ready", 5 * o, None, None), ("w", 5 * o + 10, "start", "r1"), ("w", 5 * o + 20, "complete", "r1")] for o in range(2)}
    log = make(spark, work)
    inst = bottlenecks.instances(executions.leading(log))
    assert inst.count() == 2
    for r in bottlenecks.waiting(inst).collect():
        assert r["waiting"] == pytest.approx(r["batching"] + r["contention"] + r["prioritization"] + r["unavailability"] + r["extraneous"]) and r["waiting"] == 10.0
    p = bottlenecks.resource_pressure(inst).first()
    assert p["max_queue"] == 2 and 0 < p["utilization"] <= 1
    c = bottlenecks.cascades(inst).collect()
    assert [(r["activities"], r["support"], r["depth"], r["delay"]) for r in c] == [(["w", "w"], 1, 1, 5.0)]
    assert bottlenecks.patterns(inst).first()["overtaking"] == 0.0


def test_time_covered_by_intervals(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    spans = spark.createDataFrame([("r", at(a), at(b)) for a, b in ((0, 10), (5, 20), (30, 40), (50, 50))], "resource string, lo timestamp, hi timestamp")
    work = spark.createDataFrame([(0, "r", at(8), at(35)), (1, "r", at(-5), at(0)), (2, "r", at(20), at(30)), (3, "r", at(100), at(200)), (4, "s", at(0), at(9)), (5, "r", at(-5), at(300))], "row long, resource string, ready timestamp, start timestamp")
    got = {r["row"]: r["c"] for r in bottlenecks.covered(work, spans, "c").collect()}
    assert got == {0: 17.0, 1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 30.0}


def test_prediction(spark):
    log = make(spark, {i: "abc" if i % 4 else "abd" for i in range(1, 21)})
    c = cases_of(log)
    got = prediction.predict(prediction.fit(c), c, "next_activity").join(c.select("event_id", "activity"), "event_id")
    assert {r["activity"]: r["prediction"] for r in got.filter("activity in ('a', 'b')").collect()} == {"a": "b", "b": "c"}
    assert prediction.evaluate(c, "next_activity").first()["n"] > 0
    assert prediction.evaluate(c, "remaining_time").first()["score"] == pytest.approx(0.0)


def test_risk_is_deterministic(spark):
    steps = {i: [("create", 100 * i, None, None), ("approve", 100 * i + (45 if i % 5 == 0 else 2 + i % 3), None, None), ("ship", 100 * i + 60, None, None)] for i in range(16)}
    obs = executions.observations(make(spark, steps))
    assert obs.count() == 32
    a, b = risk.fit(obs), risk.fit(obs)
    assert a["hash"] == b["hash"] and a["info"]["validation_count"] == 7
    assert risk.score(obs, a).count() == 32
    with pytest.raises(EngineError):
        risk.score(obs, a | {"model": a["model"] | {"mu": []}})


def test_components(spark):
    log = make(spark, {1: "a", 2: "b", 3: "c"})
    o2o = spark.createDataFrame([(1, 1, 2, "q", None, None)], model.O2O)
    got = {r["object_id"]: r["execution_id"] for r in executions.components(log.having(o2o=o2o)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def same(a: Log, b: Log):
    key = lambda log: sorted((r["external_event_id"], r["activity"], r["ts"]) for r in log.events.collect())
    pairs = lambda log: sorted((r["external_event_id"], r["external_object_id"]) for r in log.e2o.join(log.events, "event_id").join(log.objects, "object_id").collect())
    return key(a) == key(b) and pairs(a) == pairs(b)


def test_formats_come_back(spark, tmp_path):
    log = make(spark, {1: "ab", 2: "a<"})
    e = Engine(log)
    e.write("canonical_json", str(tmp_path / "c.json"))
    back = Engine.read(spark, "canonical_json", str(tmp_path / "c.json")).log
    assert same(log, back) and {r["attributes"]["status"]["s"] for r in back.events.collect()} == {"open", "closed"}
    e.write("ocel_json", str(tmp_path / "o.json"))
    assert same(log, Engine.read(spark, "ocel_json", str(tmp_path / "o.json")).log)
    e.write("xes", str(tmp_path / "x.xes"), object_type="order")
    assert same(log, Engine.read(spark, "xes", str(tmp_path / "x.xes"), object_type="order").log)
    e.write("csv", str(tmp_path / "c.csv"), object_type="order")
    assert same(log, Engine.read(spark, "csv", str(tmp_path / "c.csv"), event_id="event_id", object_type="order").log)
    e.write("sqlite", str(tmp_path / "s.db"))
    assert same(log, Engine.read(spark, "sqlite", str(tmp_path / "s.db")).log)
    root = str(tmp_path / "store")
    m = e.write("parquet", root, version="v1")
    assert m["files"]["events"]["rows"] == 4
    assert same(log, Engine.read(spark, "parquet", root, selection=readers.Selection("current"), validation="strict").log)
    writers.verify_snapshot(root, "v1")
    with pytest.raises(EngineError):
        e.write("parquet", root, version="v1")
    with pytest.raises(EngineError):
        readers.select_root(spark, root, readers.Selection("fixed", "../x"))


def test_ocel_shapes_and_csv(spark, tmp_path):
    doc = {"ocel:events": {"e1": {"ocel:activity": "pay", "ocel:timestamp": "2024-01-01T00:00:00Z", "ocel:omap": ["o1"], "ocel:vmap": {"x": 1}}}, "ocel:objects": {"o1": {"ocel:type": "order"}}}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    log = readers.read_ocel_json(spark, str(tmp_path / "p.json"))
    r = log.events.first()
    assert (r["external_event_id"], r["activity"], r["attributes"]["x"]["i"], log.e2o.count()) == ("e1", "pay", 1, 1)
    (tmp_path / "f.csv").write_text('case_id,activity,timestamp,note\nc1,go,2024-01-01T00:00:00Z,"a,b"\nc1,stop,2024-01-01 01:00:00,\n')
    log = readers.read_csv(spark, str(tmp_path / "f.csv"))
    got = {r["external_event_id"]: r["attributes"] for r in log.events.collect()}
    assert got["row-2"]["note"]["s"] == "a,b" and got["row-3"] == {}
    assert log.events.orderBy("ts").collect()[1]["ts"].replace(tzinfo=None) == datetime(2024, 1, 1, 1)


def test_relational_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "o.db")
    con.executescript("""
    CREATE TABLE event(ocel_id TEXT, ocel_type TEXT); CREATE TABLE event_map_type(ocel_type TEXT, ocel_type_map TEXT); CREATE TABLE event_Go(ocel_id TEXT, ocel_time TEXT, x INT);
    CREATE TABLE object(ocel_id TEXT, ocel_type TEXT); CREATE TABLE object_map_type(ocel_type TEXT, ocel_type_map TEXT); CREATE TABLE object_Order(ocel_id TEXT, ocel_time TEXT, ocel_changed_field TEXT, p INT, q INT);
    CREATE TABLE event_object(ocel_event_id TEXT, ocel_object_id TEXT, ocel_qualifier TEXT); CREATE TABLE object_object(ocel_source_id TEXT, ocel_target_id TEXT, ocel_qualifier TEXT);
    INSERT INTO event VALUES ('z', 'go'), ('a', 'go'); INSERT INTO event_map_type VALUES ('go', 'Go'); INSERT INTO event_Go VALUES ('z', '2024-01-01 00:00:00', 1), ('a', '2024-01-01 00:00:00', 2);
    INSERT INTO object VALUES ('o', 'order'); INSERT INTO object_map_type VALUES ('order', 'Order'); INSERT INTO object_Order VALUES ('o', '2024-01-01', 'p', 5, 6);
    INSERT INTO event_object VALUES ('z', 'o', 'x'), ('a', 'o', 'x'); INSERT INTO object_object VALUES ('o', 'missing', 'y');
    """)
    con.commit()
    con.close()
    log = readers.read_sqlite(spark, str(tmp_path / "o.db"))
    c = cases_of(log).orderBy("pos").collect()
    assert [r["external_event_id"] for r in c] == ["z", "a"]  # rows as they were put in break ties
    assert [(r["name"], r["value"]["i"]) for r in log.object_attrs.collect()] == [("p", 5)] and log.o2o.count() == 0


def test_local_times(spark):
    df = spark.createDataFrame([("2024-10-27 02:30:00",)], "t string").select(F.to_timestamp("t").alias("t"))
    early = readers.to_utc(df, "t", "iana", "Europe/Berlin", "earliest").first()["t"]
    late = readers.to_utc(df, "t", "iana", "Europe/Berlin", "latest").first()["t"]
    assert (late - early).total_seconds() == 3600
    with pytest.raises(Exception, match="twice"):
        readers.to_utc(df, "t", "iana", "Europe/Berlin").collect()


def test_append_and_streams(spark, tmp_path):
    log = make(spark, {1: "ab"}).having(watermark=T0)
    f = spark.createDataFrame
    batch = {"events": f([(3, "e3", "ship", T0 + timedelta(seconds=9), None, None, 0, None, {})], model.EVENTS), "e2o": f([(1, 3, 1, "case")], model.E2O)}
    new = append(log, batch, T0 + timedelta(seconds=9))
    assert new.events.count() == 3 and sorted(r["relation_id"] for r in new.e2o.collect()) == [1, 2, 3]
    with pytest.raises(EngineError, match="watermark"):
        append(new, {}, T0)
    with pytest.raises(EngineError):
        append(log, {"e2o": f([(9, 77, 1, "")], model.E2O)}, None)
    whole = Summary().add(make(spark, {1: "ab"})).add(make(spark, {2: "abb"})).result()
    assert counts(whole, "source", "target") == {("a", "b"): 2, ("b", "b"): 1}
    rows = f([(1, 1, "a", T0), (2, 1, "b", T0 + timedelta(seconds=5)), (3, 2, "a", T0)], "event_id long, user_id long, event_type string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for df, mode, name in ((pairs_by_case(stream), "append", "pairs"), (windowed_counts(stream, "1 minute"), "complete", "windows")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = running_graph(spark.table("pairs")).collect()
    assert [(r["source"], r["target"], r["mean_seconds"]) for r in got] == [("a", "b", 5.0)]
    assert {r["activity"]: r["n"] for r in spark.table("windows").collect()} == {"a": 2, "b": 1}


def test_validation_finds_what_is_wrong(spark):
    log = make(spark, {1: "ab"})
    bad = log.having(e2o=log.e2o.union(spark.createDataFrame([(1, 99, 98, "")], model.E2O)))
    got = {r["rule"]: r["violations"] for r in model.validate(bad).collect()}
    assert got["e2o_event_missing"] == got["e2o_object_missing"] == got["e2o_relation_repeated"] == 1
    assert not any(r["violations"] for r in model.validate(log).collect())


def test_engine_requests(spark):
    e = Engine(make(spark, {1: "abc", 2: "ab"}))
    assert e.profile().first()["events"] == 5
    s = e.execution_summary({"semantic_version": "1.0"})
    assert s["totals"].first().asDict() == {"cases": 2, "events": 5}
    a = e.discover({"algorithm": "dfg"})
    assert e.check({"model": a, "method": "frequency_coverage"}).first()["fitness"] == 1.0
    assert e.enhance({"kind": "rework"}).count() == 0
    assert "PhysicalRDD" in (x := e.explain({"view": {"activities": ["a"]}}))["plan"] or "Scan" in x["plan"]
    assert x["predicates"] == ["activities=('a',)"]
    with pytest.raises(EngineError):
        e.discover({"algorithm": "dfg", "semantic_version": "9"})
    for kind in ("json", "dot", "svg"):
        assert writers.export(a["model"], kind)
    assert "<pnml" in writers.export(discovery.alpha(e.cases()), "pnml")


def test_plan_has_no_nested_loop(spark):
    plan = executions.leading(make(spark, {1: "ab"}))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_results_do_not_depend_on_partitions(spark):
    log = make(spark, {i: "abcab"[: 1 + i % 5] for i in range(1, 30)})
    many = log.having(events=log.events.repartition(7), e2o=log.e2o.repartition(5))
    assert counts(stats.dfg(cases_of(log)), "source", "target") == counts(stats.dfg(cases_of(many)), "source", "target")


def test_endpoints(spark):
    from tracelake.plans import endpoints

    log = make(spark, {1: "abc", 2: "abc", 3: "ac"})
    base = {"backbone_type": "order", "source_activity": "a", "target_activity": "b", "windows": [(T0, T0 + timedelta(days=1))]}
    for name in endpoints.ENDPOINTS:
        for frame in endpoints.answer(log, base | {"endpoint": name}).values():
            assert frame.count() > 0, name
    got = endpoints.answer(log, {"endpoint": "dynamic_dfg", "backbone_type": "order", "edges": [{"source": "a", "target": "c"}]})["dfg"].collect()
    assert [(r["source"], r["target"], r["frequency"]) for r in got] == [("a", "c", 1)]
    for bad in ({"endpoint": "timeline"}, {"endpoint": "nothing"}, {"endpoint": "edge_info", "backbone_type": "x"}, {"endpoint": "case_list", "backbone_type": "x", "limit": 0}, {"endpoint": "timeline", "backbone_type": "x", "timeline_period": "eon"}):
        with pytest.raises(EngineError):
            endpoints.answer(log, bad)


def test_follow_goes_on_after_a_restart(spark, tmp_path):
    from tracelake.streaming.append import follow

    root = str(tmp_path / "store")
    writers.write_snapshot(make(spark, {1: "ab"}).having(watermark=None), root, "v0")
    schema = "event_id long, user_id long, kind string, ts timestamp"

    def to_batch(df):
        none = F.create_map().cast(f"map<string,{model.VALUE}>")
        ts = F.col("ts")
        events = df.select("event_id", F.concat(F.lit("x"), F.col("event_id").cast("string")).alias("external_event_id"), F.col("kind").alias("activity"), ts, (F.unix_micros(ts) * 1000).cast("decimal(38,0)").alias("ts_nanos"), F.lit(None).cast("string").alias("source_ts"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("lifecycle"), none.alias("attributes"))
        return {"events": events, "e2o": df.select(F.row_number().over(executions.Window.orderBy("event_id")).cast("long").alias("relation_id"), "event_id", F.col("user_id").alias("object_id"), F.lit("case").alias("qualifier"))}

    load = lambda: readers.read_snapshot(spark, root, readers.Selection("current"))
    for k in range(2):  # a new query each time: nothing is held between them
        spark.createDataFrame([(100 + k, 1, f"late{k}", T0 + timedelta(days=k + 1))], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = follow(stream, load, lambda log, number: writers.write_snapshot(log, root, f"b{number}"), to_batch, str(tmp_path / "checkpoint"))
        q.processAllAvailable()
        q.stop()
    log = load()
    assert sorted(r["activity"] for r in log.events.collect()) == ["a", "b", "late0", "late1"] and log.e2o.count() == 4


def test_snapshot_hashes_under_strict(spark, tmp_path):
    root = str(tmp_path / "s")
    writers.write_snapshot(make(spark, {1: "ab"}), root, "v1")
    assert readers.read_snapshot(spark, root, readers.Selection("current"), "strict").events.count() == 2
    manifest = tmp_path / "s/versions/v1/manifest.json"
    d = json.loads(manifest.read_text())
    d["files"]["events"]["parts"][0]["sha256"] = "sha256:00"
    manifest.write_text(json.dumps(d))
    with pytest.raises(EngineError, match="hash"):
        readers.read_snapshot(spark, root, readers.Selection("current"), "strict")


def test_tabular_prefixes_count_objects(spark):
    log = make(spark, {1: "ab", 2: "ab"})
    link = spark.createDataFrame([(1, 1, 2, "with", None, None)], model.O2O)
    cases = executions.ordered(executions.distinct_events(executions.components(log.having(o2o=link))))
    assert {r["key"].rsplit("|", 1)[1] for r in prediction.prefixes(cases, 1, tabular=True).collect()} == {"2"}
    assert {r["key"].rsplit("|", 1)[1] for r in prediction.prefixes(cases_of(log), 1, tabular=True).collect()} == {"1"}


@pytest.mark.parametrize("target", ["next_activity", "remaining_time"])
def test_holdout_takes_the_share_as_a_decimal(spark, target):
    """0.7 of 90 cases are 63, though 90 * 0.7 is less than that in floating point."""
    assert [prediction.training_size(n, 0.7) for n in (10, 90, 90_000)] == [7, 63, 63_000]
    cases = cases_of(make(spark, {o: [("a", o, None, None), ("b", o + 0.5, None, None)] for o in range(90)}))
    train, test = prediction.holdout(cases)
    assert sorted(r[0] for r in test.select("execution_id").distinct().collect()) == list(range(63, 90))
    assert train.select("execution_id").distinct().count() == 63
    assert prediction.evaluate(cases, target).first()["n"] == (27 if target == "next_activity" else 54)


def test_executions_of_linked_events_are_those_of_the_relations(spark):
    from tracelake.sources import demo

    log = demo.orders(spark, "/root/testdata/sf0.001")
    plain = log.having()
    assert log.linked is not None and plain.linked is None
    for view in (View(), View(object_types=("order",)), View(object_types=("part", "supplier"), activities=("ship",)), View(qualifiers=("customer", "part"))):
        a, b = (executions.leading(x, view, attributes=False) for x in (log, plain))
        assert sorted(a.columns) == sorted(b.columns)
        assert a.count() == b.count() > 0 and a.exceptAll(b.select(a.columns)).count() == 0
    # lines are shuffled when they are written, and then events once, dealt by object; each relation made its own before
    plan = stats.dfg(executions.ordered(executions.leading(log, attributes=False)), by_type=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 12 and "SortMergeJoin" not in plan.split("Window")[0]
    assert demo.orders(spark, "/root/testdata/sf0.001").linked.inputFiles() == log.linked.inputFiles()


def test_json_documents_are_read_in_pieces():
    import io

    doc = {"a": [{"x": "]}, \\"}, {"y": [1, {"z": "é"}]}], "n": 12345678, "none": [], "m": {"k": {"q": None}}, "last": True}
    for indent in (None, 2):
        text = json.dumps(doc, indent=indent, ensure_ascii=False)
        for size in (1, 7, 1 << 20):
            got = [(k, listed, json.loads(e)) for k, listed, e in readers.pieces(io.StringIO(text).read, size)]
            assert got == [*[("a", True, x) for x in doc["a"]], ("n", False, 12345678), ("m", False, doc["m"]), ("last", False, True)]
        with pytest.raises(EngineError):
            list(readers.pieces(io.StringIO(text[:-1]).read, 7))


def test_exchange_formats_keep_rows_off_the_driver(spark, tmp_path, monkeypatch):
    """Writers let tasks make the text, a database is read a few rows at a time; entries of maps by id come too."""
    from pyspark.sql import DataFrame

    log = make(spark, {1: "ABA", 2: "CB"})
    want = {(r["activity"], r["n"]) for r in log.events.groupBy("activity").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: pytest.fail("rows came to the driver"))
    monkeypatch.setattr(readers, "ROWS", 2)
    writers.write_ocel_json(log, f"{tmp_path}/o.json")
    writers.write_canonical_json(log, f"{tmp_path}/c.json")
    writers.write_xes(log, f"{tmp_path}/x.xes", "order")
    monkeypatch.undo()
    monkeypatch.setattr(readers, "ROWS", 2)
    writers.write_sqlite(log, f"{tmp_path}/s.sqlite")
    for name in ("o.json", "c.json"):
        json.loads((tmp_path / name).read_text())
    by_id = json.loads((tmp_path / "o.json").read_text())
    by_id = {"ocel:events": {e["id"]: {"ocel:activity": e["type"], "ocel:timestamp": e["time"], "ocel:omap": [r["objectId"] for r in e["relationships"]], "ocel:vmap": {}} for e in by_id["events"]}, "ocel:objects": {o["id"]: {"ocel:type": o["type"]} for o in by_id["objects"]}}
    (tmp_path / "m.json").write_text(json.dumps(by_id, indent=1))
    read = [readers.read_ocel_json(spark, f"{tmp_path}/o.json"), readers.read_canonical_json(spark, f"{tmp_path}/c.json"), readers.read_xes(spark, f"{tmp_path}/x.xes"), readers.read_sqlite(spark, f"{tmp_path}/s.sqlite"), readers.read_ocel_json(spark, f"{tmp_path}/m.json")]
    for back in read:
        assert {(r["activity"], r["n"]) for r in back.events.groupBy("activity").agg(F.count("*").alias("n")).collect()} == want
        assert back.e2o.count() == 5
