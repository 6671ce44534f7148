"""Appends and incremental summaries with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake import model
from tracelake.model import EngineError, Log
from tracelake.operators.executions import leading, ordered
from tracelake.operators.stats import dfg_durations


def append(log: Log, batch: dict[str, DataFrame], watermark: datetime | None, check: bool = True) -> Log:
    """``log`` with a batch of rows for its relations. The watermark must not go back; relation ids of the batch go on behind
    those of the log; the new log is validated as a whole, or not at all."""
    if log.watermark is not None and watermark is not None and watermark < log.watermark:
        raise EngineError("watermark_regression", f"{watermark} is before {log.watermark}")
    unknown = set(batch) - set(model.RELATIONS)
    if unknown:
        raise EngineError("invalid_request", f"no such relations: {sorted(unknown)}")
    out = {}
    for name, df in log.relations().items():
        new = batch.get(name)
        if new is None:
            out[name] = df
            continue
        if name in ("e2o", "o2o"):
            top = df.agg(F.max("relation_id")).first()[0] or 0
            low = new.agg(F.min("relation_id")).first()[0]
            new = new.withColumn("relation_id", F.col("relation_id") + F.lit(top + 1 - (low or 0)))
        out[name] = df.unionByName(new.select(*df.columns))
    made = log.having(**out, watermark=watermark or log.watermark)
    if check:
        bad = [r["rule"] for r in model.validate(made).filter("violations > 0").collect()]
        if bad:
            raise EngineError("invalid_data", ", ".join(bad))
    return made


def follow(stream: DataFrame, load: Callable[[], Log], save: Callable[[Log, int], None], to_batch: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str):
    """A streaming query that appends each micro-batch to the log that ``load`` gives, the last that was saved, and hands the new
    one to ``save``, for example as a snapshot version named by the batch's number. Nothing is held between batches: after a
    restart the log goes on from what is stored. A batch that was saved and is tried again is a conflict for ``save``: it
    counts once."""

    def one(df: DataFrame, number: int) -> None:
        log = append(load(), to_batch(df), df.agg(F.max("ts")).first()[0], check=False)
        try:
            save(log, number)
        except EngineError as error:
            if error.code != "conflict":
                raise

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


def pairs_by_case(events: DataFrame, case: str = "user_id", activity: str = "event_type", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Neighbouring events of each case from a stream in event order: source, target, seconds, ts. State for each case is its
    last event; an event before it is an error of its order, and is counted in ``late`` rather than lost."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        last = state.get if state.exists else None
        out = []
        for r in rows.itertuples():
            us = int(r.ts.value // 1000)
            if last is not None:
                out.append((last[1], r.activity, (us - last[0]) / 1e6, r.ts, us < last[0]))
            if last is None or us >= last[0]:
                last = (us, r.activity)
        state.update(last)
        yield pd.DataFrame(out, columns=["source", "target", "seconds", "ts", "late"])

    slim = events.select(F.col(case).alias("case"), F.col(activity).alias("activity"), F.col(ts).cast("timestamp").alias("ts"), "event_id").withWatermark("ts", delay)
    return slim.groupBy("case").applyInPandasWithState(step, "source string, target string, seconds double, ts timestamp, late boolean", "us long, activity string", "append", GroupStateTimeout.NoTimeout)


def running_graph(pairs: DataFrame) -> DataFrame:
    """source, target, frequency, mean_seconds so far: sums that merge, kept by the engine (update or complete mode)."""
    return pairs.filter("not late").groupBy("source", "target").agg(F.count("*").alias("frequency"), F.avg("seconds").alias("mean_seconds"))


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour", activity: str = "event_type", ts: str = "ts") -> DataFrame:
    """window start, activity, n over event time, late events up to ``delay``."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return e.groupBy(w.alias("w"), F.col(activity).alias("activity")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "activity", "n")


class Summary:
    """A graph summary that batches of whole cases are added to; adding in any order gives the same."""

    def __init__(self) -> None:
        self._parts: DataFrame | None = None

    def add(self, log: Log) -> Summary:
        cases = ordered(leading(log, attributes=False))
        part = dfg_durations(cases).select("source", "target", "frequency", (F.col("mean_seconds") * F.col("frequency")).alias("total"))
        self._parts = part if self._parts is None else self._parts.union(part)
        return self

    def result(self) -> DataFrame:
        if self._parts is None:
            raise EngineError("invalid_request", "nothing was added")
        return self._parts.groupBy("source", "target").agg(F.sum("frequency").alias("frequency"), (F.sum("total") / F.sum("frequency")).alias("mean_seconds"))
