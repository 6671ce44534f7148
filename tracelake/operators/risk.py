"""A graph model of slow steps: two mean-aggregating layers over observations that share an object or an event.

Features and the graph are made by Spark; training is NumPy on the driver within a stated bound; scoring joins messages
and runs on executors.
"""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.storage import cut
from tracelake.model import EngineError, artifact, check_artifact
from tracelake.operators.executions import seconds

#: Observations that training takes, about, at most: those of a sample of objects, by the hash of their id. All are scored.
NODES = 20_000
HASHED, HIDDEN, DEGREE = 16, 16, 32
DAY, WEEK = 86_400.0, 7 * 86_400.0


class Backend(Protocol):
    """What a predictive backend offers: a model is a plain dict, an artifact with a content hash."""

    def fit(self, obs: DataFrame, threshold: float) -> dict: ...

    def score(self, obs: DataFrame, model: dict) -> DataFrame: ...


def bucket(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "big") % HASHED


def nodes(obs: DataFrame) -> DataFrame:
    """A row for each observation: node, edge columns, features (hashed types and activities, cyclic time, place, waiting before it);
    its own duration is no feature."""
    own = Window.partitionBy("object_id").orderBy("source_ts", "source_external_event_id")
    before = F.coalesce(seconds("source_ts", F.lag("source_ts").over(own)), F.lit(0.0))
    t = F.unix_micros("source_ts") / 1e6
    one = lambda c, salt: F.transform(F.sequence(F.lit(0), F.lit(HASHED - 1)), lambda i: (F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), c)), 1, 8), 16, 10).cast("long"), F.lit(HASHED)) == i).cast("double"))
    cyc = F.array(*[f(F.lit(2 * np.pi) * F.pmod(t, F.lit(p)) / p) for p in (DAY, WEEK) for f in (F.sin, F.cos)])
    place = F.array(F.log1p(F.row_number().over(own).cast("double")), F.log1p(F.greatest(before, F.lit(0.0))))
    x = F.concat(one(F.col("object_type"), "t"), one(F.col("source_activity"), "a"), one(F.col("target_activity"), "b"), cyc, place)
    node = F.concat_ws(":", "object_id", "source_event_id", "target_event_id")
    return obs.select(node.alias("node"), "object_id", "object_type", "source_activity", "target_activity", "source_event_id", "target_event_id", "source_ts", "target_ts", x.alias("x"), seconds("target_ts", "source_ts").alias("duration"))


def edges(n: DataFrame) -> DataFrame:
    """a, b, both ways: neighbouring observations of an object, and those that share an event (source or target) with another, at
    most DEGREE from each node (the nearest in order of node)."""
    seq = n.select("node", F.lead("node").over(Window.partitionBy("object_id").orderBy("source_ts", "node")).alias("other")).filter("other is not null")
    # each with the next ones of its event: no event makes all pairs
    ends = n.select("node", F.explode(F.array("source_event_id", "target_event_id")).alias("event")).distinct()
    following = Window.partitionBy("event").orderBy("node").rowsBetween(1, DEGREE)
    hub = ends.withColumn("others", F.collect_list("node").over(following)).select("node", F.explode("others").alias("other"))
    e = seq.union(hub).distinct()
    both = e.select(F.col("node").alias("a"), F.col("other").alias("b")).union(e.select("other", "node")).distinct()
    return both.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("_r") <= DEGREE).drop("_r")


def _sums(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Of rows by their place."""
    out = np.zeros((n, rows.shape[1]))
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.append(True, at[order][1:] != at[order][:-1]))
        out[at[order][first]] = np.add.reduceat(rows[order], first)
    return out


def _forward(w: dict, x: np.ndarray, a: np.ndarray, b: np.ndarray, n: int):
    deg = np.maximum(np.bincount(a, minlength=n), 1)[:, None]

    def mean(h: np.ndarray) -> np.ndarray:
        return _sums(h[b], a, n) / deg

    m0 = mean(x)
    h1 = np.tanh(x @ w["s1"] + m0 @ w["n1"] + w["b1"])
    m1 = mean(h1)
    h2 = np.tanh(h1 @ w["s2"] + m1 @ w["n2"] + w["b2"])
    return m0, h1, m1, h2, 1 / (1 + np.exp(-np.clip(h2 @ w["o"] + w["bo"], -30, 30))), deg


def train(x: np.ndarray, a: np.ndarray, b: np.ndarray, y: np.ndarray, fit: np.ndarray, held: np.ndarray, epochs: int = 200, rate: float = 0.02, patience: int = 20, seed: int = 17) -> tuple[dict, dict]:
    """Adam on the cross entropy of ``fit`` nodes; stops when that of ``held`` nodes no longer falls. The same input gives the same weights."""
    rng, n, d = np.random.default_rng(seed), len(x), x.shape[1]
    shapes = {"s1": (d, HIDDEN), "n1": (d, HIDDEN), "b1": (HIDDEN,), "s2": (HIDDEN, HIDDEN), "n2": (HIDDEN, HIDDEN), "b2": (HIDDEN,), "o": (HIDDEN,), "bo": ()}
    w = {k: rng.normal(0, 1 / np.sqrt(max(1, s[0] if s else 1)), s) if k[0] != "b" else np.zeros(s) for k, s in shapes.items()}
    m1, m2 = ({k: np.zeros(s) for k, s in shapes.items()} for _ in range(2))
    best, kept, wait, done = np.inf, w, 0, 0
    loss = lambda p, k: float(-(y[k] * np.log(p[k] + 1e-9) + (1 - y[k]) * np.log(1 - p[k] + 1e-9)).mean()) if k.any() else 0.0
    for done in range(1, epochs + 1):
        m0, h1, mm, h2, p, deg = _forward(w, x, a, b, n)
        now = loss(p, held if held.any() else fit)
        if now < best - 1e-5:
            best, kept, wait = now, {k: v.copy() for k, v in w.items()}, 0
        elif (wait := wait + 1) > patience:
            break
        dz = np.where(fit, p - y, 0.0) / max(1, fit.sum())
        g = {"o": h2.T @ dz, "bo": dz.sum()}
        d2 = np.outer(dz, w["o"]) * (1 - h2 * h2)
        g |= {"s2": h1.T @ d2, "n2": mm.T @ d2, "b2": d2.sum(axis=0)}
        back = _sums(((d2 @ w["n2"].T) / deg)[a], b, n)
        d1 = (d2 @ w["s2"].T + back) * (1 - h1 * h1)
        g |= {"s1": x.T @ d1, "n1": m0.T @ d1, "b1": d1.sum(axis=0)}
        for k in w:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.999 * m2[k] + 0.001 * g[k] * g[k]
            w[k] = w[k] - rate * (m1[k] / (1 - 0.9**done)) / (np.sqrt(m2[k] / (1 - 0.999**done)) + 1e-8)
    return kept, {"loss": round(best, 6), "epochs": done, "train_count": int(fit.sum()), "validation_count": int(held.sum())}


def fit(obs: DataFrame, threshold: float | None = None, share: float = 0.8) -> dict:
    """Trains on the earlier ``share`` of observations (of a sample of objects, if they are over NODES); slow is over the threshold (by default each edge type's
    90th percentile is learnt with the model)."""
    n = nodes(obs)
    count = n.count()
    if count > NODES:
        n = cut(n.filter(F.pmod(F.xxhash64("object_id", F.lit(5)), F.lit(1 << 20)) < int(NODES / count * (1 << 20))))
    if not count:
        raise EngineError("invalid_data", "no observations")
    pdf = n.orderBy("target_ts", "node").toPandas()
    e = edges(n).toPandas()
    at = {v: i for i, v in enumerate(pdf["node"])}
    a, b = e["a"].map(at).to_numpy(dtype=int), e["b"].map(at).to_numpy(dtype=int)
    x = np.stack(pdf["x"].to_list())
    k = int(len(pdf) * share)
    first = np.arange(len(pdf)) < k
    key = pdf["source_activity"] + ">" + pdf["target_activity"]
    limits = pdf[first].groupby(key[first])["duration"].quantile(0.9).to_dict() if threshold is None else {}
    overall = float(pdf["duration"][first].quantile(0.9)) if threshold is None and first.any() else threshold
    y = (pdf["duration"] > key.map(limits).fillna(overall)).to_numpy(dtype=float)
    mu, sd = x[first].mean(axis=0), x[first].std(axis=0)
    sd[sd < 1e-9] = 1.0
    w, info = train((x - mu) / sd, a, b, y, first, ~first)
    body = {k: np.round(v, 9).tolist() for k, v in w.items()}
    return artifact("risk_model", "mean_sage", {"weights": body, "mu": mu.tolist(), "sd": sd.tolist(), "limits": limits, "threshold": overall}, info=info)


def _weights(model: dict) -> tuple[dict, np.ndarray, np.ndarray]:
    w = {k: np.array(v) for k, v in model["weights"].items()}
    mu, sd = np.array(model["mu"]), np.array(model["sd"])
    if w["s1"].shape != (len(mu), HIDDEN) or w["s2"].shape != (HIDDEN, HIDDEN):
        raise EngineError("invalid_artifact", "weights of another shape")
    return w, mu, sd


def score(obs: DataFrame, model_artifact: dict) -> DataFrame:
    """node, edge columns, duration and risk of every observation. The two layers are two joins of messages with means by
    node, so the graph may be of any size; the weights travel with the code."""
    w, mu, sd = _weights(check_artifact(model_artifact, "risk_model"))
    n = nodes(obs)
    e = edges(n)

    def layer(df: DataFrame, self_w: np.ndarray, near_w: np.ndarray, bias: np.ndarray, scale: bool) -> DataFrame:
        width = len(self_w)
        sums = [F.avg(F.col("h")[i]).alias(f"m{i}") for i in range(width)]
        mean = e.join(df.select(F.col("node").alias("b"), "h"), "b").groupBy(F.col("a").alias("node")).agg(*sums).select("node", F.array(*[f"m{i}" for i in range(width)]).alias("m"))

        def run(batches):
            for p in batches:
                if not len(p):
                    continue
                x = np.stack(p["h"].to_list())
                m = np.stack([v if v is not None else np.zeros(width) if not scale else mu * 0 + np.nan for v in p["m"]])
                if scale:
                    x, m = (x - mu) / sd, np.nan_to_num((m - mu) / sd)
                yield pd.DataFrame({"node": p["node"], "h": list(np.tanh(x @ self_w + m @ near_w + bias))})

        return df.select("node", "h").join(mean, "node", "left").mapInPandas(run, "node string, h array<double>")

    h = layer(n.select("node", F.col("x").alias("h")), w["s1"], w["n1"], w["b1"], True)
    h = layer(h, w["s2"], w["n2"], w["b2"], False)
    z = F.lit(float(w["bo"]))
    for i, v in enumerate(w["o"]):
        z = z + F.col("h")[i] * float(v)
    return n.drop("x").join(h.select("node", (1 / (1 + F.exp(-z))).alias("risk")), "node")


def detect(obs: DataFrame, model_artifact: dict, least: int = 1) -> DataFrame:
    """Per edge: support, mean_risk and risk-weighted excess over the mean duration, largest first."""
    keys = ["object_type", "source_activity", "target_activity"]
    s = score(obs, model_artifact)
    mean = s.groupBy(*keys).agg(F.avg("duration").alias("_mean"))
    by = s.join(mean, keys).groupBy(*keys).agg(F.count("*").alias("support"), F.avg("risk").alias("mean_risk"), F.sum(F.col("risk") * F.greatest(F.col("duration") - F.col("_mean"), F.lit(0.0))).alias("excess"))
    return by.filter(F.col("support") >= least).orderBy(F.desc("excess"), F.desc("mean_risk"), F.desc("support"), *keys)
