"""Analytics of grouped counts: coverage models, next activities, drift, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.order import numbered
from tracelake.functions.storage import cut
from tracelake.model import EngineError


def coverage_model(rows: DataFrame, keys: list[str], coverage: float, train: str = "train") -> DataFrame:
    """The fewest rows, by count and then key, whose counts reach ceil(coverage * total); rows without a count never.

    The cut falls within the rows of one count: a running sum over the different counts, which are few, finds it. Rows of
    larger counts are in, of smaller ones out, and those of that count alone are put in order."""
    if not 0 < coverage <= 1:
        raise EngineError("invalid_request", "coverage is over 0, 1 at most")
    some = rows.filter(F.col(train) > 0)
    sizes = some.groupBy(F.col(train).alias("c")).agg(F.count("*").alias("n")).withColumn("s", F.col("c") * F.col("n"))
    up_to = F.sum("s").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))  # a row for each count
    need = F.ceil(F.sum("s").over(Window.partitionBy()) * F.lit(coverage) - F.lit(1e-9))
    at = sizes.withColumn("up", up_to).withColumn("need", need).filter("up >= need").orderBy(F.desc("c")).first()
    if at is None:
        return some.limit(0)
    more = -(-int(at["need"] - (at["up"] - at["s"])) // int(at["c"]))  # rows of that count that are needed
    own = some.filter(F.col(train) == at["c"])
    if more >= at["n"]:
        return some.filter(F.col(train) >= at["c"])
    last = own.orderBy(*keys).limit(more) if more <= 10_000 else numbered(own, "_n", *keys).filter(F.col("_n") <= more).drop("_n")
    return some.filter(F.col(train) > at["c"]).union(last.select(*some.columns))


def frequency_conformance(rows: DataFrame, keys: list[str], coverage: float) -> DataFrame:
    """One row: conforming, deviations, fitness (1 without test rows), model_size. rows: keys, train, test."""
    rows = cut(rows)  # a row for each element, looked at several times
    model = coverage_model(rows, keys, coverage).select(*keys).withColumn("_in", F.lit(True))
    # model keys are not null: they come from rows of counted elements
    met = rows.join(model, keys, "left")
    out = met.agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col("test"))), F.lit(0)).alias("conforming"), F.coalesce(F.sum(F.when(F.col("_in").isNull(), F.col("test"))), F.lit(0)).alias("deviations"), F.count_if("_in").alias("model_size"))
    total = F.col("conforming") + F.col("deviations")
    return out.withColumn("fitness", F.when(total == 0, F.lit(1.0)).otherwise(F.col("conforming") / total))


def next_activity(rows: DataFrame, per: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """per, predicted, train: the target of most training steps for each key; ties to the smaller name; none without training."""
    order = Window.partitionBy(*per).orderBy(F.desc("train"), "target")
    return rows.filter("train > 0").withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*per, F.col("target").alias("predicted"), "train")


def score_next(rows: DataFrame, per: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """One row: correct and total test steps, accuracy (1 without any)."""
    met = rows.join(next_activity(rows, per).drop("train"), per, "left")
    out = met.agg(F.coalesce(F.sum(F.when(F.col("target") == F.col("predicted"), F.col("test"))), F.lit(0)).alias("correct"), F.coalesce(F.sum("test"), F.lit(0)).alias("total"))
    return out.withColumn("accuracy", F.when(F.col("total") == 0, 1.0).otherwise(F.col("correct") / F.col("total")))


def drift_terms(rows: DataFrame, label: str, empty: float = 1.0) -> DataFrame:
    """label, baseline, current, contribution: terms of the base-2 Jensen-Shannon divergence of two count columns; equal labels
    are one. Both sides empty: zeros. One side empty: shares of the other, which sum to ``empty``."""
    by = rows.groupBy(label).agg(F.sum("baseline").alias("baseline"), F.sum("current").alias("current"))
    everything = Window.partitionBy()  # a row for each label
    p = F.try_divide(F.col("baseline").cast("double"), F.sum("baseline").over(everything))
    q = F.try_divide(F.col("current").cast("double"), F.sum("current").over(everything))
    by = by.withColumn("p", p).withColumn("q", q)
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m) / 2).otherwise(0.0)
    alone = F.coalesce(F.col("p"), F.col("q"), F.lit(0.0)) * F.lit(empty)
    term = F.when(F.col("p").isNull() | F.col("q").isNull(), alone).otherwise(F.greatest(half("p") + half("q"), F.lit(0.0)))
    return by.select(label, "baseline", "current", term.alias("contribution"))


def frequency_drift(rows: DataFrame, label: str, top: int = 10, empty: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(one row: divergence; the ``top`` labels by contribution, then label)."""
    t = drift_terms(rows, label, empty)
    return t.agg(F.least(F.coalesce(F.sum("contribution"), F.lit(0.0)), F.lit(1.0)).alias("divergence")), t.orderBy(F.desc("contribution"), label).limit(top)


def bottleneck_order(rows: DataFrame, ordinal: str) -> DataFrame:
    """rows with rank: mean duration, then frequency, both falling, then the place in the input."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_seconds"), F.desc("frequency"), ordinal)))


def edge_prediction(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rmse of test durations against the training mean of their edge, brier of slow outcomes against the training
    rate, and n. train: keys, mean_seconds, slow_rate. test: keys, frequency, mean_seconds, sum_squares, slow_count."""
    met = test.join(train.select(*keys, F.col("mean_seconds").alias("_m"), F.col("slow_rate").alias("_r")), keys)
    n, s = F.col("frequency"), F.col("mean_seconds") * F.col("frequency")
    square = F.col("sum_squares") - 2 * F.col("_m") * s + n * F.col("_m") * F.col("_m")
    brier = F.col("slow_count") * (1 - F.col("_r")) * (1 - F.col("_r")) + (n - F.col("slow_count")) * F.col("_r") * F.col("_r")
    out = met.agg(F.sum(n).alias("n"), F.sum(square).alias("_a"), F.sum(brier).alias("_b"))
    return out.select("n", F.sqrt(F.greatest(F.col("_a") / F.col("n"), F.lit(0.0))).alias("rmse"), (F.col("_b") / F.col("n")).alias("brier"))


def split_counts(cases: DataFrame, train: Column, keys: dict[str, Column]) -> DataFrame:
    """keys, train, test: numbers of rows of ``cases`` on either side of a split."""
    return cases.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.count_if(train).alias("train"), F.count_if(~train).alias("test"))
