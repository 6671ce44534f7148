"""Conformance: coverage, token replay, alignments, declarative templates. What depends on a trace alone runs once for
each distinct trace, on executors, and counts by its frequency."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.model import EngineError, check_artifact
from tracelake.operators import stats

STATES = 1_000_000


def frequency_coverage(cases: DataFrame, model: dict) -> DataFrame:
    """One row: steps, conforming, fitness, precision (share of the model's edges that occur), simplicity, violating executions."""
    allowed = [(e[0], e[1]) for e in model["edges"]]
    spark = cases.sparkSession
    edges = spark.createDataFrame(sorted(set(allowed)), "activity string, next_activity string").withColumn("ok", F.lit(True))
    # a model's edges: at most the square of its activities
    met = stats.steps(cases).join(F.broadcast(edges) if len(allowed) <= 100_000 else edges, ["activity", "next_activity"], "left")
    by = met.groupBy("execution_id").agg(F.count("*").alias("steps"), F.count_if("ok").alias("good"))
    seen = met.filter("ok").select("activity", "next_activity").distinct().agg(F.count("*").alias("seen"))
    out = by.agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"), F.coalesce(F.sum("good"), F.lit(0)).alias("conforming"), F.count_if(F.col("steps") > F.col("good")).alias("violating_executions"))
    n = max(1, len(set(allowed)))
    out = out.join(seen, how="cross")  # two rows of one number each
    return out.select("steps", "conforming", F.when(F.col("steps") == 0, 1.0).otherwise(F.col("conforming") / F.col("steps")).alias("fitness"), (F.col("seen") / n).alias("precision"), F.lit(1.0 / (1 + len(set(allowed)))).alias("simplicity"), "violating_executions")


def replay_trace(net: dict, trace: list[str]) -> tuple[int, int, int, int]:
    """(missing, remaining, consumed, produced) tokens of one trace; an activity that the net lacks takes and leaves one."""
    into, out = {}, {}
    for a in net["arcs"]:
        s, t = a[0], a[1]
        (into if t.startswith("t:") else out).setdefault(t if t.startswith("t:") else s, []).append(s if t.startswith("t:") else t)
    known = {t["id"] for t in net["transitions"]}
    tokens = dict(net["initial"])
    missing, consumed, produced = 0, 0, sum(tokens.values())
    for a in trace:
        t = f"t:{a}"
        if t not in known:
            missing += 1
            consumed += 1
            produced += 1
            continue
        for p in into.get(t, ()):
            if tokens.get(p, 0) > 0:
                tokens[p] -= 1
            else:
                missing += 1
            consumed += 1
        for p in out.get(t, ()):
            tokens[p] = tokens.get(p, 0) + 1
            produced += 1
    final = net["final"]
    for p, n in final.items():
        lack = max(0, n - tokens.get(p, 0))
        missing += lack
        consumed += n
    remaining = sum(abs(tokens.get(p, 0) - final.get(p, 0)) for p in set(tokens) | set(final))
    return missing, remaining, consumed, produced


def _fitness(missing: Column, remaining: Column, consumed: Column, produced: Column) -> Column:
    return F.lit(1.0) - F.lit(0.5) * missing / F.greatest(consumed, F.lit(1)) - F.lit(0.5) * remaining / F.greatest(produced, F.lit(1))


def token_replay(cases: DataFrame, net: dict) -> DataFrame:
    """path, frequency, missing, remaining, consumed, produced, fitness for each distinct trace."""
    traces = stats.case_summary(cases).groupBy("path", "activities").agg(F.count("*").alias("frequency"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [replay_trace(net, list(t)) for t in b["activities"]]
            yield pd.DataFrame({"path": b["path"], "frequency": b["frequency"], **{k: [g[i] for g in got] for i, k in enumerate(("missing", "remaining", "consumed", "produced"))}})

    out = traces.mapInPandas(run, "path string, frequency long, missing long, remaining long, consumed long, produced long")
    return out.withColumn("fitness", _fitness(*[F.col(c) for c in ("missing", "remaining", "consumed", "produced")]))


def log_fitness(replayed: DataFrame) -> DataFrame:
    """One row: tokens of all executions and the fitness they give."""
    total = replayed.agg(*[F.coalesce(F.sum(F.col(c) * F.col("frequency")), F.lit(0)).alias(c) for c in ("missing", "remaining", "consumed", "produced")], F.count_if(F.col("missing") + F.col("remaining") > 0).alias("violating_variants"))
    return total.withColumn("fitness", _fitness(*[F.col(c) for c in ("missing", "remaining", "consumed", "produced")]))


def align_trace(model: dict, trace: list[str], states: int = STATES) -> tuple[int, list]:
    """Cost and moves of a cheapest alignment to a graph: synchronous moves are free, log and model moves cost one."""
    nxt: dict = {}
    for e in model["edges"]:
        nxt.setdefault(e[0], set()).add(e[1])
    starts, ends = sorted(model["starts"]), set(model["ends"])
    queue, done, tie = [(0, 0, 0, None, ())], set(), 0
    while queue:
        cost, _, i, at, path = heapq.heappop(queue)
        if (i, at) in done:
            continue
        done.add((i, at))
        if len(done) > states:
            raise EngineError("resource_limit", f"an alignment of over {states} states")
        if i == len(trace) and (at in ends or (at is None and not trace and not starts)):
            moves: list = []
            while path:
                moves.append(path[0])
                path = path[1]
            return cost, moves[::-1]
        options = starts if at is None else sorted(nxt.get(at, ()))
        for b in options:
            tie += 1
            if i < len(trace) and trace[i] == b:
                heapq.heappush(queue, (cost, tie, i + 1, b, (["sync", b], path)))
            heapq.heappush(queue, (cost + 1, tie, i, b, (["model", b], path)))
        if i < len(trace):
            tie += 1
            heapq.heappush(queue, (cost + 1, tie, i + 1, at, (["log", trace[i]], path)))
    return len(trace), [["log", a] for a in trace]


def alignment(cases: DataFrame, model: dict) -> DataFrame:
    """path, frequency, cost, fitness, method for each distinct trace. Graphs only; nets are replayed, and ``method`` says so."""
    if model["type"] != "dfg":
        return token_replay(cases, model).select("path", "frequency", (F.col("missing") + F.col("remaining")).alias("cost"), "fitness", F.lit("token_replay").alias("method"))
    shortest = align_trace(model, [])[0] if model["starts"] else 0
    traces = stats.case_summary(cases).groupBy("path", "activities").agg(F.count("*").alias("frequency"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cost = [align_trace(model, list(t))[0] for t in b["activities"]]
            worst = [len(t) + shortest for t in b["activities"]]
            yield pd.DataFrame({"path": b["path"], "frequency": b["frequency"], "cost": cost, "fitness": [1.0 - c / w if w else 1.0 for c, w in zip(cost, worst)]})

    return traces.mapInPandas(run, "path string, frequency long, cost long, fitness double").withColumn("method", F.lit("alignment"))


TEMPLATES = ("existence", "absence", "exactly", "init", "end", "response", "precedence", "succession", "coexistence", "not_coexistence", "choice", "exclusive_choice")


def check_declare(cases: DataFrame, constraints: list[dict]) -> DataFrame:
    """template, a, b, holds, violations. A constraint is a boolean over an execution's first and last places and counts of
    its two activities: all constraints are sums over one grouping."""
    names = sorted({c[k] for c in constraints for k in ("a", "b") if c.get(k) is not None})
    at = {n: i for i, n in enumerate(names)}
    sums = []
    for n, i in at.items():
        own = F.when(F.col("activity") == n, F.col("pos"))
        sums += [F.min(own).alias(f"lo{i}"), F.max(own).alias(f"hi{i}"), F.count(own).alias(f"n{i}")]
    by = cases.groupBy("execution_id").agg(*sums, F.min_by("activity", "pos").alias("first"), F.max_by("activity", "pos").alias("last"))

    def test(c: dict) -> Column:
        k, a, b = c["template"], c["a"], c.get("b")
        if k not in TEMPLATES:
            raise EngineError("invalid_request", f"no such template: {k}")
        n = F.col(f"n{at[a]}")
        has = n > 0
        if k in ("existence", "absence", "exactly"):
            return {"existence": has, "absence": ~has, "exactly": n == 1}[k]
        if k in ("init", "end"):
            return F.col("first" if k == "init" else "last") == a
        if b is None:
            raise EngineError("invalid_request", f"{k} needs two activities")
        has_b = F.col(f"n{at[b]}") > 0
        response = ~has | (has_b & (F.col(f"hi{at[a]}") < F.col(f"hi{at[b]}")))
        precedence = ~has_b | (has & (F.col(f"lo{at[a]}") < F.col(f"lo{at[b]}")))
        return {"response": response, "precedence": precedence, "succession": response & precedence, "coexistence": has == has_b, "not_coexistence": ~(has & has_b), "choice": has | has_b, "exclusive_choice": has != has_b}[k]

    counts = by.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(test(c), F.lit(False))).alias(f"c{i}") for i, c in enumerate(constraints)])
    rows = F.explode(F.array(*[F.struct(F.lit(c["template"]).alias("template"), F.lit(c["a"]).alias("a"), F.lit(c.get("b")).cast("string").alias("b"), F.col(f"c{i}").alias("holds")) for i, c in enumerate(constraints)]))
    return counts.select("total", rows.alias("r")).select("r.*", (F.col("total") - F.col("r.holds")).alias("violations"))


def check(cases: DataFrame, model_artifact: dict, method: str) -> DataFrame:
    """The named check of a model whose hash is valid."""
    model = check_artifact(model_artifact, "model")
    if method == "frequency_coverage":
        return frequency_coverage(cases, model)
    if method == "token_replay":
        return log_fitness(token_replay(cases, model))
    if method == "ocpn_quality":
        if model.get("type") != "object_centric_petri_net":
            raise EngineError("invalid_request", "ocpn_quality is of an object-centric net")
        types = cases.agg(F.array_sort(F.collect_set("object_type")).alias("object_types_recomposed"))
        return log_fitness(token_replay(cases, model)).join(types, how="cross")  # one row each
    if method == "alignment":
        return alignment(cases, model)
    if method == "declare":
        return check_declare(cases, model["constraints"])
    raise EngineError("unsupported", f"no such method: {method}")
