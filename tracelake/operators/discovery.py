"""Model discovery. Counts are made by Spark; only graphs, distinct traces and nets reach the driver."""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.storage import written
from tracelake.model import EngineError, artifact
from tracelake.operators import stats

#: Pairs of activity sets that the net search looks at, at most.
CANDIDATES = 65_536
DEPTH = 128
#: Different traces that a tree is made of, at most.
TRACES = 200_000


def _marks(cases: DataFrame, kind) -> list:
    """k (edge, start, end), a, b, t (the type, or what ``kind`` says), n."""
    none = F.lit(None).cast("string")
    mark = lambda when, k, b: F.when(when, F.struct(F.lit(k).alias("k"), F.col("activity").alias("a"), b.alias("b"), kind.alias("t")))
    more = F.col("next_activity").isNotNull()
    # what an event counts for, as one to three rows of one aggregate: the log is read and sorted once
    marks = F.array(mark(more, "edge", F.col("next_activity")), mark(F.col("pos") == 1, "start", none), mark(~more, "end", none))
    return cases.select(F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("m")).groupBy("m.k", "m.a", "m.b", "m.t").agg(F.count("*").alias("n")).collect()


def _graph(rows: list, by_type: bool = False) -> dict:
    counts: dict[str, Counter] = {"edge": Counter(), "start": Counter(), "end": Counter()}
    for r in rows:
        counts[r["k"]][(r["a"], r["b"], *([r["t"]] if by_type else [])) if r["k"] == "edge" else r["a"]] += r["n"]
    edges = sorted(([*e, n] for e, n in counts["edge"].items()), key=lambda r: [str(x) for x in r])
    start, end = (dict(sorted(counts[k].items())) for k in ("start", "end"))
    names = sorted({e[0] for e in edges} | {e[1] for e in edges} | set(start) | set(end))
    return {"type": "dfg", "activities": names, "edges": edges, "starts": start, "ends": end}


def graph(cases: DataFrame, by_type: bool = False) -> dict:
    """edges [source, target(, type), n], starts and ends (merged over types), activities."""
    return _graph(_marks(cases, F.col("object_type") if by_type else F.lit(None).cast("string")), by_type)


def _petri(g: dict) -> dict:
    """Net of the alpha algorithm: maximal pairs of sets that cause each other and are unordered among themselves."""
    follows = {(e[0], e[1]) for e in g["edges"]}
    names = g["activities"]
    causes = {(a, b) for a, b in follows if (b, a) not in follows}
    free = lambda a, b: (a, b) not in follows and (b, a) not in follows
    seeds = {(frozenset([a]), frozenset([b])) for a, b in causes if free(a, a) and free(b, b)}
    found, fresh = set(seeds), set(seeds)
    while fresh:
        new = set()
        for (a, b), (c, d) in ((x, y) for x in fresh for y in found):
            if a != c and b != d:
                continue
            p, q = a | c, b | d
            if (p, q) in found or (p, q) in new:
                continue
            if all(free(x, y) for s in (p, q) for x, y in combinations(sorted(s), 2)) and all((x, y) in causes for x in p for y in q):
                new.add((p, q))
                if len(found) + len(new) > CANDIDATES:
                    raise EngineError("resource_limit", f"over {CANDIDATES} candidate places")
        found |= new
        fresh = new
    top = [(a, b) for a, b in found if not any((a, b) != (c, d) and a <= c and b <= d for c, d in found)]
    places, arcs = ["source", "sink"], [["source", f"t:{a}"] for a in sorted(g["starts"])] + [[f"t:{a}", "sink"] for a in sorted(g["ends"])]
    for i, (a, b) in enumerate(sorted((sorted(a), sorted(b)) for a, b in top)):
        places.append(f"p{i}")
        arcs += [[f"t:{x}", f"p{i}"] for x in a] + [[f"p{i}", f"t:{y}"] for y in b]
    return {"type": "petri_net", "places": places, "transitions": [{"id": f"t:{a}", "label": a} for a in names], "arcs": arcs, "initial": {"source": 1}, "final": {"sink": 1}}


def alpha(cases: DataFrame) -> dict:
    return _petri(graph(cases))


def object_net(cases: DataFrame) -> dict:
    """The net, each arc with its object type if the activity has but one, and ``variable`` where it touches several."""
    rows = _marks(cases, F.col("object_type"))
    net = _petri(_graph(rows))
    types: dict[str, set] = {}
    for r in rows:  # each event is a start, an edge's source or an end, and each counts by type
        types.setdefault(r["a"], set()).add(r["t"])
    for arc in net["arcs"]:
        own = sorted(types.get(next(x for x in arc if x.startswith("t:"))[2:], ()))
        arc += [own[0] if len(own) == 1 else None, len(own) > 1]
    return net | {"type": "object_centric_petri_net"}


def _leaf(a: str) -> dict:
    return {"op": "activity", "label": a}


def _in_a_row(children: list[dict]) -> dict:
    """A sequence without silent steps; of one child, the child."""
    some = [c for c in children if c["op"] != "tau"]
    return {"op": "sequence", "children": some} if len(some) > 1 else some[0] if some else {"op": "tau"}


def _one_way(names: list[str], follows: set[tuple[str, str]]) -> list[str]:
    """The activities in an order of the relations that hold one way only, smaller names first; shorter than all if these
    go round."""
    after = {a: [b for b in names if (a, b) in follows and (b, a) not in follows] for a in names}
    waits = Counter(b for bs in after.values() for b in bs)
    ready, out = [a for a in names if not waits[a]], []
    heapq.heapify(ready)
    while ready:
        out.append(heapq.heappop(ready))
        for b in after[out[-1]]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(ready, b)
    return out


def _tree(traces: Counter, depth: int = 0) -> dict:
    """Peels common first and last activities; else a choice by first activity, if these share no activity; else all in
    parallel, if each directly follows each other; else the order of direct relations, if they go one way; else a loop of the
    most frequent trace (ties: the smallest) around its first activity. One activity alone is that activity, however often
    it occurs. Traces of which some, not all, are empty at this point are a choice of the others and of nothing."""
    full = Counter({t: n for t, n in traces.items() if t})
    if not full:
        return {"op": "tau"}
    names = sorted({a for t in full for a in t})
    if len(names) == 1:
        return _leaf(names[0])
    modal = min(full, key=lambda t: (-full[t], t))
    if depth >= DEPTH:
        return {"op": "sequence", "children": [_leaf(a) for a in modal]}
    if len(full) < len(traces):
        return {"op": "xor", "children": [_tree(full, depth + 1), {"op": "tau"}]}
    firsts, lasts = {t[0] for t in full}, {t[-1] for t in full}
    if len(firsts) == 1:
        return _in_a_row([_leaf(firsts.pop()), _tree(_merge((t[1:], n) for t, n in full.items()), depth + 1)])
    if len(lasts) == 1:
        return _in_a_row([_tree(_merge((t[:-1], n) for t, n in full.items()), depth + 1), _leaf(lasts.pop())])
    by = {f: _merge((t, n) for t, n in full.items() if t[0] == f) for f in sorted(firsts)}
    seen = Counter(a for ts in by.values() for a in {a for t in ts for a in t})
    if max(seen.values()) == 1:
        return {"op": "xor", "children": [_tree(ts, depth + 1) for ts in by.values()]}
    follows = {(a, b) for t in full for a, b in zip(t, t[1:])}
    if all((a, b) in follows and (b, a) in follows for a, b in combinations(names, 2)):
        return {"op": "parallel", "children": [_leaf(a) for a in names]}
    order = _one_way(names, follows)
    if len(order) == len(names):
        return {"op": "sequence", "children": [_leaf(a) for a in order]}
    return {"op": "loop", "children": [_leaf(modal[0]), _in_a_row([_leaf(a) for a in modal[1:]])]}


def _merge(pairs) -> Counter:
    out: Counter = Counter()
    for t, n in pairs:
        out[t] += n
    return out


def process_tree(cases: DataFrame) -> dict:
    """From distinct traces and their counts: these come to the driver, cases do not. TRACES of them at most."""
    rows = stats.case_summary(cases).groupBy("activities").agg(F.count("*").alias("n")).limit(TRACES + 1).collect()
    if len(rows) > TRACES:
        raise EngineError("resource_limit", f"over {TRACES} different traces")
    return {"type": "process_tree", "root": _tree(_merge((tuple(r["activities"]), r["n"]) for r in rows))}


def declare(cases: DataFrame, support: float = 0.8, strict: bool = False) -> DataFrame:
    """template, a, b, holds, base, confidence: existence(a) over all executions, response(a, b) of cases where every a is
    followed by some b.

    base: executions with a for existence, all for response; executions without a hold vacuously, which confidence counts
    against those with a, so it may be over 1 (strict: only executions with a count). Pairs are made within a row of the
    activities an execution has, each with its last place."""
    at = written(cases.groupBy("execution_id", "activity").agg(F.max("pos").alias("last"), F.bool_or(F.col("pos") == 1).alias("first")))
    total = at.agg(F.count_if("first")).first()[0]
    has = at.groupBy("activity").agg(F.count("*").alias("with_a"))
    existence = has.select(F.lit("existence").alias("template"), F.col("activity").alias("a"), F.lit(None).cast("string").alias("b"), F.col("with_a").alias("holds"), F.lit(total).cast("long").alias("base"), (F.col("with_a") / F.lit(max(1, total))).alias("confidence"))
    held = at.groupBy("execution_id").agg(F.collect_list(F.struct("activity", "last")).alias("h"))
    pairs = F.expr("flatten(transform(h, x -> transform(filter(h, y -> x.last < y.last), y -> struct(x.activity as a, y.activity as b))))")
    met = held.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("met"))
    pair = met.join(has.withColumnRenamed("activity", "a"), "a")
    holds = F.col("met") if strict else F.col("met") + F.lit(total) - F.col("with_a")
    response = pair.select(F.lit("response").alias("template"), "a", "b", holds.cast("long").alias("holds"), F.lit(total).cast("long").alias("base"), (holds / F.col("with_a")).alias("confidence"), F.col("with_a"))
    enough = (F.col("holds") / F.col("with_a") if strict else F.col("holds") / F.lit(max(1, total))) >= support
    return existence.filter(F.col("confidence") >= support).union(response.filter(enough).drop("with_a"))


def discover(cases: DataFrame, algorithm: str, **how) -> dict:
    """The named model as an artifact. Accepts oc_dfg as object_centric_dfg too."""
    a = algorithm.lower().replace("object_centric_dfg", "oc_dfg").replace("_", "")
    if a == "dfg":
        return artifact("model", "dfg", graph(cases))
    if a == "ocdfg":
        return artifact("model", "ocdfg", graph(cases, by_type=True))
    if a in ("alpha", "petrinet"):
        return artifact("model", a, alpha(cases))
    if a in ("inductive", "processtree"):
        return artifact("model", a, process_tree(cases))
    if a in ("ocpn", "objectcentricpetrinet"):
        return artifact("model", a, object_net(cases))
    if a in ("declare", "ocdeclare"):
        rows = declare(cases, **how).orderBy("template", "a", "b").collect()
        return artifact("model", a, {"type": "declare", "constraints": [r.asDict() for r in rows]})
    raise EngineError("unsupported", f"no such algorithm: {algorithm}")
