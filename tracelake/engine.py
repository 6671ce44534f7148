"""The engine: typed requests over one log, answered with DataFrames or plain dicts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake import model
from tracelake.model import SEMANTIC_VERSION, EngineError, Log, View
from tracelake.operators import bottlenecks, conformance, constraints, discovery, enhancement, executions, prediction, risk, stats
from tracelake.sources import readers, writers
from tracelake.streaming.append import append

#: What the engine answers, for callers that ask before they request.
CAPABILITIES = {
    "sources": ["canonical_json", "ocel_json", "csv", "xes", "sqlite", "parquet", "entity_links", "serving", "jdbc"],
    "sinks": ["canonical_json", "ocel_json", "csv", "xes", "sqlite", "parquet"],
    "requests": ["profile", "snapshot", "execution_summary", "query", "discover", "check", "enhance", "bottlenecks", "predict", "risk", "explain"],
    "exact": True,
}


def _version(request: dict) -> dict:
    if request.get("semantic_version", SEMANTIC_VERSION) != SEMANTIC_VERSION:
        raise EngineError("unsupported", f"semantic version {request['semantic_version']}")
    return {k: v for k, v in request.items() if k != "semantic_version"}


def _instant(x: Any) -> datetime:
    return datetime.fromisoformat(x.replace("Z", "+00:00")) if isinstance(x, str) else x


def to_dict(result: Any) -> Any:
    """DataFrames as lists of rows, all through dicts and lists."""
    if isinstance(result, DataFrame):
        return [r.asDict(recursive=True) for r in result.collect()]
    if isinstance(result, dict):
        return {k: to_dict(v) for k, v in result.items()}
    return result


class Engine:
    def __init__(self, log: Log, spark: SparkSession | None = None) -> None:
        self.log = log
        self.spark = spark or log.events.sparkSession

    @classmethod
    def read(cls, spark: SparkSession, kind: str, path: str, **how: Any) -> Engine:
        """kind: one of CAPABILITIES["sources"]."""
        readers_ = {"canonical_json": readers.read_canonical_json, "ocel_json": readers.read_ocel_json, "csv": readers.read_csv, "xes": readers.read_xes, "sqlite": readers.read_sqlite, "parquet": readers.read_snapshot, "entity_links": readers.read_entity_links, "serving": readers.read_serving, "jdbc": readers.read_jdbc}
        if kind not in readers_:
            raise EngineError("unsupported", f"no such source: {kind}")
        return cls(readers_[kind](spark, path, **how), spark)

    def write(self, kind: str, path: str, **how: Any) -> Any:
        writers_ = {"canonical_json": writers.write_canonical_json, "ocel_json": writers.write_ocel_json, "csv": writers.write_csv, "xes": writers.write_xes, "sqlite": writers.write_sqlite, "parquet": writers.write_snapshot}
        if kind not in writers_:
            raise EngineError("unsupported", f"no such sink: {kind}")
        return writers_[kind](self.log, path, **how)

    def validate(self) -> DataFrame:
        return model.validate(self.log)

    def append(self, batch: dict[str, DataFrame], watermark: datetime | None = None) -> Engine:
        return Engine(append(self.log, batch, watermark), self.spark)

    def profile(self, view: dict | None = None) -> DataFrame:
        return executions.profile(self.log, View.parse(view))

    def snapshot(self, view: dict | None = None) -> Engine:
        return Engine(executions.snapshot(self.log, View.parse(view)), self.spark)

    def cases(self, view: dict | None = None, mode: str = "leading", object_type: str | None = None, attributes: bool = True) -> DataFrame:
        """Ordered executions of a view; mode: leading or component."""
        v = View.parse(view)
        if mode == "component":
            return executions.ordered(executions.distinct_events(executions.components(self.log, v)))
        return executions.ordered(executions.leading(self.log, v, object_type, attributes=attributes))

    def execution_summary(self, request: dict) -> dict[str, DataFrame]:
        r = _version(request)
        cases = self.cases(r.get("view"), r.get("mode", "leading"), r.get("object_type"), attributes=False)
        if r.get("complete_lifecycle"):
            v = View.parse(r.get("view"))
            whole = executions.leading(self.log, View.parse({k: x for k, x in (r.get("view") or {}).items() if k not in ("start", "end")}), r.get("object_type"), attributes=False)
            cases = executions.ordered(stats.contained(whole, v.start, v.end))
        return stats.summary(cases)

    def query(self, request: dict) -> dict:
        return constraints.query(self.log, _version(request))

    def discover(self, request: dict) -> dict:
        r = _version(request)
        return discovery.discover(self.cases(r.get("view"), r.get("mode", "leading"), r.get("object_type")), r["algorithm"], **r.get("parameters", {}))

    def check(self, request: dict) -> DataFrame:
        r = _version(request)
        return conformance.check(self.cases(r.get("view"), r.get("mode", "leading"), r.get("object_type")), r["model"], r["method"])

    def enhance(self, request: dict) -> Any:
        r = _version(request)
        cases = self.cases(r.get("view"), r.get("mode", "leading"), r.get("object_type"))
        kind = r["kind"]
        if kind in ("window_comparison", "drift"):
            return enhancement.compare(cases, self.cases(r["comparison_view"], r.get("mode", "leading"), r.get("object_type")), r.get("by", "dfg"))
        if kind == "performance":  # needs every object of an event
            v = View.parse(r.get("view"))
            return enhancement.performance(executions.components(self.log, v) if r.get("mode") == "component" else executions.leading(self.log, v, r.get("object_type"), attributes=False))
        kinds: dict[str, Callable] = {"process_map": enhancement.process_map, "timeline": enhancement.dotted_chart, "histogram": enhancement.cycle_histogram, "rework": enhancement.rework, "organizational": enhancement.organisation}
        if kind not in kinds:
            raise EngineError("unsupported", f"no such enhancement: {kind}")
        return kinds[kind](cases)

    def bottlenecks(self, request: dict) -> dict[str, DataFrame | None]:
        r = _version(request)
        resource = r.get("resource", "resource")
        view = View.parse(r.get("view"))
        obs = executions.observations(self.log, view, keep=[resource])
        base = executions.observations(self.log, View.parse(r["comparison_view"]), keep=[resource]) if r.get("comparison_view") else None
        work = bottlenecks.instances(executions.leading(self.log, view, every_type=True), resource)
        if r.get("population"):
            ids = executions.population(self.log, **r["population"]).withColumnRenamed("execution_id", "object_id")
            obs, work = obs.join(ids, "object_id", "left_semi"), work.join(ids, "object_id", "left_semi")
        hours = [(who, *map(_instant, span)) for who, spans in r.get("resource_calendars", {}).items() for span in spans]
        calendars = obs.sparkSession.createDataFrame(hours, "resource string, lo timestamp, hi timestamp") if hours else None
        asked = {"minimum_support": "least", "batch_tolerance_seconds": "tolerance", "minimum_batch_size": "least_batch"}
        return bottlenecks.suite(obs, work, base, r.get("hypotheses", []), r.get("threshold"), calendars=calendars, **{n: r[k] for k, n in asked.items() if k in r})

    def fit_prediction(self, request: dict) -> dict[str, DataFrame]:
        r = _version(request)
        return prediction.fit(self.cases(r.get("view"), object_type=r.get("object_type")), r.get("order", 3), r.get("tabular", False))

    def predict(self, fitted: dict[str, DataFrame], request: dict) -> DataFrame:
        r = _version(request)
        return prediction.predict(fitted, self.cases(r.get("view"), object_type=r.get("object_type")), r["target"], r.get("order", 3), r.get("tabular", False))

    def evaluate_prediction(self, request: dict) -> DataFrame:
        r = _version(request)
        return prediction.evaluate(self.cases(r.get("view"), object_type=r.get("object_type")), r["target"], r.get("order", 3), r.get("share", 0.7))

    def fit_risk(self, request: dict, backend: risk.Backend = risk) -> dict:
        return backend.fit(executions.observations(self.log, View.parse(request.get("view"))), request.get("threshold"))

    def score_risk(self, artifact: dict, request: dict, backend: risk.Backend = risk) -> DataFrame:
        return backend.score(executions.observations(self.log, View.parse(request.get("view"))), artifact)

    def detect_risk(self, artifact: dict, request: dict) -> DataFrame:
        return risk.detect(executions.observations(self.log, View.parse(request.get("view"))), artifact)

    def explain(self, request: dict) -> dict:
        """The restrictions a request's view sets and the physical plan of its cases."""
        cases = self.cases(request.get("view"), request.get("mode", "leading"), request.get("object_type"), attributes=False)
        run = cases._jdf.queryExecution()
        return {"predicates": View.parse(request.get("view")).summary(), "plan": run.toString(), "estimated_bytes": int(str(run.optimizedPlan().stats().sizeInBytes()))}

    def run(self, work: Callable[[Engine], Any], deadline: float | None = None) -> Any:
        """``work(self)`` under a tag, so that another thread may ``cancel`` it; past the deadline (seconds) it is cancelled."""
        import threading

        tag = f"request-{uuid.uuid4().hex}"
        late = threading.Event()
        timer = threading.Timer(deadline, lambda: (late.set(), self.spark.sparkContext.cancelJobsWithTag(tag))) if deadline else None
        self.spark.sparkContext.addJobTag(tag)
        if timer:
            timer.start()
        try:
            return to_dict(work(self))
        except Exception as error:
            if late.is_set():
                raise EngineError("deadline_exceeded", f"over {deadline} s") from error
            if "cancelled" in str(error).lower():
                raise EngineError("cancelled", "the request was cancelled") from error
            raise
        finally:
            self.spark.sparkContext.removeJobTag(tag)
            if timer:
                timer.cancel()


def closure(log: Log, seeds: list[int], depth: int) -> DataFrame:
    """object_id, depth: objects that ``depth`` O2O links or fewer (either way) lead to from the seeds, each at its nearest
    depth. A join for each step, so cycles end."""
    from tracelake.functions.storage import cut

    both = log.o2o.select(F.col("source_object_id").alias("a"), F.col("target_object_id").alias("b")).union(log.o2o.select("target_object_id", "source_object_id")).distinct()
    spark = log.o2o.sparkSession
    found = spark.createDataFrame([(s, 0) for s in seeds], "object_id long, depth int")
    front = found
    for d in range(1, depth + 1):
        nxt = both.join(front.select(F.col("object_id").alias("a")), "a").select(F.col("b").alias("object_id")).distinct()
        front = cut(nxt.join(found, "object_id", "left_anti").withColumn("depth", F.lit(d)))
        if not front.limit(1).count():
            break
        found = cut(found.union(front))
    return found
