"""Request shapes of process dashboards: one function for each endpoint, over executions of a backbone type.

Windows include both ends here, as dashboards have them; everything else in the package is half-open.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.model import EngineError, Log, View, text_of
from tracelake.operators import constraints, executions, stats

Result = dict[str, DataFrame]


@dataclass(frozen=True)
class Request:
    endpoint: str
    backbone_type: str | None = None
    from_date: datetime | None = None
    to_date: datetime | None = None
    timeline_period: str = "week"
    status: str | None = None
    variants: tuple[str, ...] = ()
    activities: tuple[str, ...] = ()
    excluded_activities: tuple[str, ...] = ()
    related_types: tuple[str, ...] = ()
    excluded_related_types: tuple[str, ...] = ()
    edges: tuple[dict, ...] = ()
    excluded_edges: tuple[dict, ...] = ()
    min_execution_time: float | None = None
    max_execution_time: float | None = None
    attributes: dict[str, list[str]] = field(default_factory=dict)
    excluded_attributes: dict[str, list[str]] = field(default_factory=dict)
    source_activity: str | None = None
    target_activity: str | None = None
    windows: tuple[tuple[datetime, datetime], ...] = ()
    slow_threshold: float = 3600.0
    limit: int = 20
    offset: int = 0

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> Request:
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown or "endpoint" not in raw:
            raise EngineError("invalid_request", f"unknown fields {sorted(unknown)}, or no endpoint")
        made = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()}
        for k in ("from_date", "to_date"):
            if isinstance(made.get(k), str):
                made[k] = datetime.fromisoformat(made[k].replace("Z", "+00:00"))
        r = cls(**made)
        r.check()
        return r

    def check(self) -> None:
        def need(ok: bool, message: str) -> None:
            if not ok:
                raise EngineError("invalid_request", message)

        need(self.endpoint in ENDPOINTS, f"endpoints are {sorted(ENDPOINTS)}")
        need(self.timeline_period in stats.PERIODS, f"periods are {stats.PERIODS}")
        need(not (self.from_date and self.to_date) or self.from_date <= self.to_date, "a window ends after its start")
        need(self.endpoint == "entire_process_map" or bool(self.backbone_type), f"{self.endpoint} needs backbone_type")
        need(self.endpoint != "edge_info" or bool(self.source_activity and self.target_activity), "edge_info needs two activities")
        need(1 <= self.limit <= 1000 and self.offset >= 0, "limit is 1 to 1000, offset not negative")
        lo, hi = self.min_execution_time, self.max_execution_time
        need(lo is None or hi is None or lo <= hi, "a range of durations ends after its start")
        for e in (*self.edges, *self.excluded_edges):
            need(e.get("min") is None or e.get("max") is None or e["min"] <= e["max"], "a range of an edge's durations ends after its start")


def _cases(log: Log, r: Request) -> DataFrame:
    """Ordered executions of the backbone: whole ones of the window and the parts inside of others, that fit all filters."""
    needs = bool(r.status or r.attributes or r.excluded_attributes)
    end = r.to_date + timedelta(microseconds=1) if r.to_date else None
    view = View(start=r.from_date, end=end, object_types=(r.backbone_type,) if r.backbone_type else ())
    cases = executions.ordered(executions.leading(log, view, attributes=needs))
    filters = {"statuses": (r.status,) if r.status else (), "including": r.activities, "excluding": r.excluded_activities, "edges_in": r.edges, "edges_out": r.excluded_edges, "attributes_in": r.attributes, "attributes_out": r.excluded_attributes, "related_in": r.related_types, "related_out": r.excluded_related_types}
    if any(filters.values()) or r.min_execution_time is not None or r.max_execution_time is not None:
        related = constraints.related_types(log) if r.related_types or r.excluded_related_types else None
        fit = stats.dynamic_filter(cases, related=related, min_seconds=r.min_execution_time, max_seconds=r.max_execution_time, **filters)
        cases = cases.join(fit, "execution_id", "left_semi")
    if r.variants:
        fit = stats.case_summary(cases).filter(F.col("path_hash").isin(list(r.variants))).select("execution_id")
        cases = cases.join(fit, "execution_id", "left_semi")
    return cases


def _windows(r: Request) -> list[tuple[datetime, datetime]]:
    if r.windows:
        return [(a, b + timedelta(microseconds=1)) for a, b in r.windows]
    if r.from_date is None or r.to_date is None:
        raise EngineError("invalid_request", f"{r.endpoint} needs windows")
    return [(r.from_date, r.to_date + timedelta(microseconds=1))]


def _process_map(log: Log, r: Request) -> Result:
    cases = _cases(log, r)
    out = stats.process_map(cases, r.timeline_period)
    by = executions.ordered(executions.leading(log, View(object_types=(r.backbone_type,)))).join(cases.select("execution_id", "event_id"), ["execution_id", "event_id"], "left_semi")
    for name in ("context", "actor"):
        value = text_of(F.try_element_at("attributes", F.lit(name)))
        out[f"nodes_by_{name}"] = by.groupBy("activity", value.alias(name)).agg(F.count("*").alias("frequency"))
    return out


def _entire(log: Log, r: Request) -> Result:
    return stats.process_map(executions.ordered(executions.leading(log, attributes=False)), r.timeline_period)


def _edge_info(log: Log, r: Request) -> Result:
    cases = _cases(log, r)
    hit = stats.steps(cases).filter((F.col("activity") == r.source_activity) & (F.col("next_activity") == r.target_activity))
    return {"histogram": stats.edge_histogram(cases, r.source_activity, r.target_activity), "summary": hit.agg(F.count("*").alias("frequency"), F.avg("duration").alias("mean_seconds"), F.min("duration").alias("min_seconds"), F.max("duration").alias("max_seconds"))}


ENDPOINTS: dict[str, Callable[[Log, Request], Result]] = {
    "process_map": _process_map,
    "variant_list": lambda log, r: {"variants": stats.variant_stats(_cases(log, r))},
    "timeline": lambda log, r: {"timeline": stats.timeline(_cases(log, r), r.timeline_period)},
    "case_throughput": lambda log, r: {"histogram": stats.throughput_histogram(_cases(log, r))},
    "edge_info": _edge_info,
    "case_list": lambda log, r: {"cases": stats.case_page(_cases(log, r), r.limit, r.offset, log=log)},
    "entire_process_map": _entire,
    "dynamic_dfg": lambda log, r: {"dfg": stats.dynamic_dfg(_cases(log, r))},
    "event_log_summary": lambda log, r: stats.summary(_cases(log, r)),
    "lifecycle_dfg": lambda log, r: {"dfg": stats.multi_window(_cases(log, r), _windows(r))},
    "lifecycle_variants": lambda log, r: {"variants": stats.variant_windows(_cases(log, r), _windows(r), r.activities, r.excluded_activities, r.variants)},
    "edge_features": lambda log, r: {"features": stats.edge_features(_cases(log, r), r.slow_threshold)},
}


def answer(log: Log, request: dict[str, Any]) -> Result:
    """The DataFrames of one request."""
    r = Request.parse(request)
    return ENDPOINTS[r.endpoint](log, r)
