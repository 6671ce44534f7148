"""Prediction from prefixes: tables of the last k activities, longest match first."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.order import numbered
from tracelake.model import EngineError
from tracelake.operators.executions import ORDER, seconds

ORDERS = 32


def prefixes(cases: DataFrame, order: int = 3, tabular: bool = False, outcome: Column | None = None) -> DataFrame:
    """A row for each event and length 0 to ``order`` of the history that ends in it: key, length, next_activity (null at the
    end), remaining seconds, outcome. tabular keys hold the prefix length and the number of objects too."""
    if not 0 <= order <= ORDERS:
        raise EngineError("invalid_request", f"order is 0 to {ORDERS}")
    own = Window.partitionBy("execution_id").orderBy(*ORDER)
    last = F.max("ts").over(Window.partitionBy("execution_id"))
    recent = F.collect_list("activity").over(own.rowsBetween(-(max(order, 1) - 1), 0))
    members = F.col("members") if "members" in cases.columns else F.lit(1)  # a leading execution is of one object
    p = cases.select("execution_id", "event_id", "pos", members.alias("_o"), "next_activity", seconds(last, F.col("ts")).alias("remaining"), recent.alias("_r"), (outcome if outcome is not None else F.lit(None)).cast("boolean").alias("outcome"))
    p = p.withColumn("length", F.explode(F.sequence(F.lit(0), F.least(F.lit(order), F.size("_r")))))
    tail = F.when(F.col("length") == 0, F.lit("")).otherwise(F.array_join(F.expr("slice(_r, -greatest(length, 1), greatest(length, 1))"), ">"))
    key = F.concat_ws("|", tail, F.col("pos").cast("string"), F.col("_o").cast("string")) if tabular else tail
    return p.withColumn("key", key).drop("_r", "_o")


def fit(cases: DataFrame, order: int = 3, tabular: bool = False, outcome: Column | None = None) -> dict[str, DataFrame]:
    """next (key, length, next_activity, n), remaining (key, length, n, mean, p10, p90 by nearest rank) and outcome (key,
    length, n, positives): as many rows as there are keys, not cases."""
    p = prefixes(cases, order, tabular, outcome)
    # nearest rank, from counts of equal values and their running sum: sorted and spilled, never held as one array
    own = Window.partitionBy("key", "length")
    values = p.groupBy("key", "length", "remaining").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(own.orderBy("remaining"))).withColumn("n", F.sum("c").over(own))
    at = lambda q: F.min(F.when(F.col("upto") > F.round(F.lit(q) * (F.col("n") - 1)), F.col("remaining")))
    return {
        "next": p.filter("next_activity is not null").groupBy("key", "length", "next_activity").agg(F.count("*").alias("n")),
        "remaining": values.groupBy("key", "length").agg(F.sum("c").alias("n"), (F.sum(F.col("remaining") * F.col("c")) / F.sum("c")).alias("mean"), at(0.1).alias("p10"), at(0.9).alias("p90")),
        "outcome": p.filter("outcome is not null").groupBy("key", "length").agg(F.count("*").alias("n"), F.count_if("outcome").alias("positives")),
    }


def best_next(model: dict[str, DataFrame]) -> DataFrame:
    w = Window.partitionBy("key", "length").orderBy(F.desc("n"), "next_activity")
    total = F.sum("n").over(Window.partitionBy("key", "length"))
    return model["next"].withColumn("_r", F.row_number().over(w)).withColumn("probability", F.col("n") / total).filter("_r = 1").select("key", "length", F.col("next_activity").alias("prediction"), "probability")


def predict(model: dict[str, DataFrame], cases: DataFrame, target: str, order: int = 3, tabular: bool = False) -> DataFrame:
    """execution_id, event_id, prediction (and its probability or interval) for each event, from the longest history known.

    Every length is looked up in one join; the longest that matches is kept by one aggregate."""
    p = prefixes(cases, order, tabular).select("execution_id", "event_id", "key", "length")
    if target == "next_activity":
        t, cols = best_next(model), ["prediction", "probability"]
    elif target == "remaining_time":
        t, cols = model["remaining"].withColumnRenamed("mean", "prediction"), ["prediction", "p10", "p90"]
    elif target in ("outcome", "risk"):
        t, cols = model["outcome"].withColumn("prediction", F.col("positives") / F.col("n")), ["prediction", "n"]
    else:
        raise EngineError("invalid_request", f"no such target: {target}")
    met = p.join(t, ["key", "length"])
    best = met.groupBy("execution_id", "event_id").agg(F.max_by(F.struct(*cols), "length").alias("_b"), F.max("length").alias("matched"))
    return best.select("execution_id", "event_id", "matched", *[F.col(f"_b.{c}") for c in cols])


def training_size(n: int, share: float) -> int:
    """Whole executions that ``share`` of n are. The share is the decimal number it is written as: 0.7 of 90,000 are 63,000,
    while the product of floating-point numbers falls just short of that."""
    return int(n * Fraction(str(share)))


def holdout(cases: DataFrame, share: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(training, test) events: executions by the time they end, the earlier share trains. Executions are numbered in ranges
    side by side, not in one task."""
    ends = numbered(cases.groupBy("execution_id").agg(F.max("ts").alias("_end")), "_n", "_end", "execution_id")
    split = ends.filter(F.col("_n") <= training_size(ends.count(), share)).select("execution_id")
    return cases.join(split, "execution_id", "left_semi"), cases.join(split, "execution_id", "left_anti")


def evaluate(cases: DataFrame, target: str, order: int = 3, share: float = 0.7, tabular: bool = False, outcome: Column | None = None) -> DataFrame:
    """One row: n, score. next_activity: accuracy; remaining_time: mean absolute error, and the share inside p10 to p90;
    outcome and risk: Brier score."""
    train, test = holdout(cases, share)
    got = predict(fit(train, order, tabular, outcome), test, target, order, tabular)
    truth = prefixes(test, 0, outcome=outcome).select("execution_id", "event_id", "next_activity", "remaining", "outcome")
    met = truth.join(got, ["execution_id", "event_id"])
    if target == "next_activity":
        return met.filter("next_activity is not null").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("next_activity")).cast("double")).alias("score"))
    if target == "remaining_time":
        return met.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("prediction") - F.col("remaining"))).alias("score"), F.avg(F.col("remaining").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"))
    return met.filter("outcome is not null").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("prediction") - F.col("outcome").cast("double"), 2)).alias("score"))
