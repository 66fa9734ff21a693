"""The structured query: a small tree of predicates that becomes one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.functions.columns import contains_ci

OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "contains", "is_null", "not_null")


@dataclass(frozen=True)
class Observation:
    attribute: str
    operator: str
    value: object = None

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator}")


@dataclass(frozen=True)
class Relationship:
    kind: str
    direction: str = "out"
    target_type: str | None = None
    target_name: str | None = None
    target_observations: tuple[Observation, ...] = ()


@dataclass(frozen=True)
class Event:
    kind: str
    since: str | None = None
    until: str | None = None


@dataclass(frozen=True)
class Query:
    entity_type: str
    name: str | None = None
    city: str | None = None
    observations: tuple[Observation, ...] = ()
    relationships: tuple[Relationship, ...] = ()
    events: tuple[Event, ...] = ()
    ascending: bool = False
    offset: int = 0
    limit: int | None = 50
    exclude_merged: bool = False


def _comparable(value: object) -> tuple[Column, object]:
    """The column that a value compares with, and the value in its form: numbers, truth values (as text), texts."""
    if isinstance(value, bool):
        return F.lower("value_text"), str(value).lower()
    return (F.col("value_num"), value) if isinstance(value, (int, float)) else (F.col("value_text"), value)


def predicate(p: Observation) -> Column:
    """On one observation row. Values compare with the column of their own type; other types never match."""
    if p.operator == "is_null":
        return F.col("value_text").isNull() & F.col("value_num").isNull()
    if p.operator == "not_null":
        return F.lit(True)
    if p.operator == "contains":
        return contains_ci(F.coalesce("value_text", F.col("value_num").cast("string")), str(p.value))
    if p.operator == "in":
        pairs = [_comparable(v) for v in p.value]
        return reduce(Column.__or__, [F.coalesce(col == v, F.lit(False)) for col, v in pairs], F.lit(False))
    col, v = _comparable(p.value)
    return {"eq": col == v, "neq": col != v, "gt": col > v, "gte": col >= v, "lt": col < v, "lte": col <= v}[p.operator]


def having_observation(entities: DataFrame, observations: DataFrame, p: Observation, latest_only: bool = False) -> DataFrame:
    """Entities with some observation, of any age, that fits; with ``latest_only`` the newest must."""
    rows = observations.where(F.col("attribute") == p.attribute)
    if latest_only:
        rows = rows.groupBy("entity_id", "attribute").agg(F.max_by(F.struct("value_text", "value_num"), F.struct("observed_at", "id")).alias("v")).select("entity_id", "v.*")
    return entities.join(rows.where(predicate(p)).select("entity_id"), F.col("id") == F.col("entity_id"), "left_semi")


def ends(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (near, far) for a direction: out, in or any."""
    out = edges.select(F.col("source_id").alias("near"), F.col("target_id").alias("far"), "relationship_type", "confidence")
    back = edges.select(F.col("target_id").alias("near"), F.col("source_id").alias("far"), "relationship_type", "confidence")
    return {"out": out, "in": back, "any": out.unionByName(back)}[direction]


def execute(q: Query, entities: DataFrame, observations: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Chained semi joins, then order and page; ties in the order go by id."""
    found = entities.where(F.col("entity_type") == q.entity_type)
    if q.exclude_merged:
        found = found.where(F.col("merged_into_id").isNull())
    if q.name:
        found = found.where(contains_ci(F.col("name"), q.name))
    if q.city:
        found = found.where(contains_ci(F.col("city"), q.city))
    found = reduce(lambda d, p: having_observation(d, observations, p), q.observations, found)
    for r in q.relationships:
        near = ends(edges.where(F.col("relationship_type") == r.kind), r.direction)
        if r.target_type or r.target_name or r.target_observations:
            target = entities.where(F.col("entity_type") == r.target_type) if r.target_type else entities
            target = target.where(contains_ci(F.col("name"), r.target_name)) if r.target_name else target
            target = reduce(lambda d, p: having_observation(d, observations, p), r.target_observations, target)
            near = near.join(target.select(F.col("id").alias("far")), "far", "left_semi")
        found = found.join(near.select("near"), F.col("id") == F.col("near"), "left_semi")
    for e in q.events:
        rows = events.where(F.col("event_type") == e.kind)
        rows = rows.where(F.col("occurred_at") >= F.lit(e.since).cast("timestamp")) if e.since else rows
        rows = rows.where(F.col("occurred_at") < F.lit(e.until).cast("timestamp")) if e.until else rows
        found = found.join(rows.select("entity_id"), F.col("id") == F.col("entity_id"), "left_semi")
    order = F.col("last_seen_at").asc_nulls_last() if q.ascending else F.col("last_seen_at").desc_nulls_first()
    if q.limit is None:
        return found
    return found.orderBy(order, "id").offset(q.offset).limit(q.limit)


def explain_plan(q: Query) -> list[str]:
    """What the query asks for, step by step."""
    steps = [f"type is {q.entity_type}"]
    steps += [f"name contains {q.name}"] * bool(q.name) + [f"city contains {q.city}"] * bool(q.city)
    steps += [f"some {p.attribute} {p.operator} {p.value}" for p in q.observations]
    steps += [f"{r.direction} {r.kind}" for r in q.relationships] + [f"event {e.kind}" for e in q.events]
    return [*steps, f"rows {q.offset} to {q.offset + q.limit}" if q.limit is not None else "all rows"]
