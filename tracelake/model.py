"""The canonical log: five relations, their schemas, the declarative view over them, errors and content hashes."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A typed attribute value. Equal values have equal tags and payloads: integer 1 is not float 1.0.
VALUE = "struct<type:string,s:string,i:bigint,f:double,b:boolean,t:decimal(38,0)>"
EVENTS = f"event_id bigint, external_event_id string, activity string, ts timestamp, ts_nanos decimal(38,0), source_ts string, seq bigint, lifecycle string, attributes map<string,{VALUE}>"
OBJECTS = "object_id bigint, external_object_id string, object_type string"
E2O = "relation_id bigint, event_id bigint, object_id bigint, qualifier string"
O2O = "relation_id bigint, source_object_id bigint, target_object_id bigint, qualifier string, valid_from timestamp, valid_to timestamp"
OBJECT_ATTRS = f"object_id bigint, name string, valid_from timestamp, value {VALUE}"
RELATIONS = {"events": EVENTS, "objects": OBJECTS, "e2o": E2O, "o2o": O2O, "object_attrs": OBJECT_ATTRS}
SEMANTIC_VERSION = "1.0"

# Codes of the errors that requests can end in.
ERROR_CODES = (
    "invalid_request", "invalid_data", "invalid_artifact", "unsupported", "not_found", "conflict", "resource_limit", "cancelled",
    "deadline_exceeded", "io", "parse", "provider", "internal", "schema", "watermark_regression", "stale_artifact",
)


class EngineError(Exception):
    def __init__(self, code: str, message: str) -> None:
        if code not in ERROR_CODES:
            raise ValueError(code)
        super().__init__(f"{code}: {message}")
        self.code = code


def value(v: Any) -> Column:
    """A Python value as a typed attribute."""
    kinds = {"s": "string", "i": "bigint", "f": "double", "b": "boolean", "t": "decimal(38,0)"}
    tag, slot = "null", None
    if isinstance(v, bool):
        tag, slot = "boolean", "b"
    elif isinstance(v, int):
        tag, slot = "integer", "i"
    elif isinstance(v, float):
        if v != v or v in (float("inf"), float("-inf")):
            raise EngineError("invalid_data", "attribute values are finite")
        tag, slot = "float", "f"
    elif isinstance(v, str):
        tag, slot = "string", "s"
    elif isinstance(v, datetime):
        tag, slot, v = "timestamp", "t", int(v.timestamp() * 1_000_000) * 1000
    elif v is not None:
        raise EngineError("invalid_data", f"no attribute value: {v!r}")
    return F.struct(F.lit(tag).alias("type"), *[F.lit(v if k == slot else None).cast(t).alias(k) for k, t in kinds.items()])


def typed(column: Column, kind: str) -> Column:
    """A column as a typed attribute; kind: string, integer, float, boolean or timestamp (of nanoseconds)."""
    slots = {"string": ("s", "string"), "integer": ("i", "bigint"), "float": ("f", "double"), "boolean": ("b", "boolean"), "timestamp": ("t", "decimal(38,0)")}
    own = slots[kind][0]
    return F.struct(F.lit(kind).alias("type"), *[(column if k == own else F.lit(None)).cast(t).alias(k) for k, t in slots.values()])


def text_of(v: Column) -> Column:
    """A typed attribute as text."""
    return F.coalesce(v["s"], v["i"].cast("string"), v["f"].cast("string"), v["b"].cast("string"), v["t"].cast("string"))


@dataclass(frozen=True)
class Log:
    """Five DataFrames and a header. Nothing is read until a result is asked for.

    ``linked``, if a source has it: the links (event_id, object_id, qualifier) with the type of the object and the columns of
    the event, attributes left out; what needs both joins nothing then. ``given`` has those of its columns that are the same
    for all events or follow from event_id, which are not shuffled. Both say what the relations say, or are left out."""

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame
    object_attrs: DataFrame
    dataset_id: str = "dataset"
    tenant_id: str = "default"
    watermark: datetime | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    linked: DataFrame | None = None
    given: dict[str, Column] = field(default_factory=dict)

    def relations(self) -> dict[str, DataFrame]:
        return {k: getattr(self, k) for k in RELATIONS}

    def having(self, **frames: DataFrame) -> Log:
        return replace(self, **({"linked": None} | frames))


@dataclass(frozen=True)
class View:
    """Thirteen optional restrictions; an empty list or None restricts nothing. The window is half-open: [start, end)."""

    start: datetime | None = None
    end: datetime | None = None
    object_types: tuple[str, ...] = ()
    activities: tuple[str, ...] = ()
    qualifiers: tuple[str, ...] = ()
    event_ids: tuple[int, ...] = ()
    object_ids: tuple[int, ...] = ()
    event_attributes: dict[str, Any] = field(default_factory=dict)
    object_attributes: dict[str, Any] = field(default_factory=dict)
    statuses: tuple[str, ...] = ()
    related_object_types: tuple[str, ...] = ()
    min_duration: float | None = None
    max_duration: float | None = None

    def summary(self) -> list[str]:
        """The restrictions that are set, for explain()."""
        return [f"{k}={v!r}" for k, v in self.__dict__.items() if v not in (None, (), {}, [])]

    @classmethod
    def parse(cls, raw: dict | None) -> View:
        raw = dict(raw or {})
        unknown = set(raw) - set(cls.__dataclass_fields__)
        if unknown:
            raise EngineError("invalid_request", f"unknown view fields: {sorted(unknown)}")
        for k in ("start", "end"):
            if isinstance(raw.get(k), str):
                raw[k] = datetime.fromisoformat(raw[k].replace("Z", "+00:00"))
        out = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})
        if out.start and out.end and out.start >= out.end:
            raise EngineError("invalid_request", "a window ends after its start")
        return out


def canonical_json(v: Any) -> str:
    """JSON with sorted keys and no white space; equal values give equal text."""
    return json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False, default=str)


def content_hash(v: Any) -> str:
    return "sha256:" + hashlib.sha256(canonical_json(v).encode()).hexdigest()


def artifact(kind: str, algorithm: str, model: Any, **extra: Any) -> dict:
    """A derived model with its content hash."""
    body = {"kind": kind, "algorithm": algorithm.lower(), "semantic_version": SEMANTIC_VERSION, "model": model, **extra}
    return body | {"hash": content_hash(body)}


def check_artifact(a: dict, kind: str | None = None) -> dict:
    body = {k: v for k, v in a.items() if k != "hash"}
    if a.get("hash") != content_hash(body):
        raise EngineError("invalid_artifact", "the content does not have the hash it names")
    if kind and a["kind"] != kind:
        raise EngineError("invalid_artifact", f"expected {kind}, got {a['kind']}")
    return a["model"]


def validate(log: Log) -> DataFrame:
    """``rule, violations`` for every integrity rule; all zero for a sound log. Duplicates by aggregation, endpoints by anti
    joins: nothing is collected."""
    ev, ob, e2o, o2o, at = log.events, log.objects, log.e2o, log.o2o, log.object_attrs

    def twice(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")

    def missing(df: DataFrame, column: str, to: DataFrame, key: str) -> DataFrame:
        return df.join(to, df[column] == to[key], "left_anti")

    rules = {
        "event_text_empty": ev.filter("coalesce(external_event_id, '') = '' or coalesce(activity, '') = ''"),
        "object_text_empty": ob.filter("coalesce(external_object_id, '') = '' or coalesce(object_type, '') = ''"),
        "event_id_repeated": twice(ev, "event_id"),
        "external_event_id_repeated": twice(ev, "external_event_id"),
        "object_id_repeated": twice(ob, "object_id"),
        "e2o_relation_repeated": twice(e2o, "relation_id"),
        "o2o_relation_repeated": twice(o2o, "relation_id"),
        "e2o_event_missing": missing(e2o, "event_id", ev, "event_id"),
        "e2o_object_missing": missing(e2o, "object_id", ob, "object_id"),
        "o2o_source_missing": missing(o2o, "source_object_id", ob, "object_id"),
        "o2o_target_missing": missing(o2o, "target_object_id", ob, "object_id"),
        "o2o_interval_empty": o2o.filter("valid_to <= valid_from"),
        "attribute_object_missing": missing(at, "object_id", ob, "object_id"),
        "attribute_change_repeated": twice(at, "object_id", "name", "valid_from"),
    }
    out = None
    for name, df in rules.items():
        row = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = row if out is None else out.union(row)
    return out
