"""Typed facts about companies (observations, events, relationships with their age), bound to the driver's tables, and the same as SQL.

Each column is one expression in the SQL that both engines share. Ages are whole days before the date of the question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph.sources.tables import Tables


def _choice(of: str, names: list[str]) -> str:
    return f"CASE {of} % {len(names)} " + " ".join(f"WHEN {n} THEN '{x}'" for n, x in enumerate(names)) + " END"


ATTRIBUTES = "revenue employees meta_pixel google_tag_manager ssl has_chatbot has_booking load_speed_seconds seo_disaster rating last_audited_at investing_marketing category mobile_friendly phone email".split()
EVENTS = "new_hiring expansion_started market_entered tender_won supplier_sought registry_change crm_installed crm_change website_changed funding_received ads_started pixel_installed new_director executive_change".split()
LINKS = "located_in awarded_to uses hires has competes_with".split()
JOBS = ["Digital marketing lead", "Cook", "CMO", "Driver", "Web developer"]
INDUSTRIES = ["restaurant", "building", "legal", "retail"]

_OBSERVED = {
    "id": "o_orderkey * 4 + k",
    "entity_id": "'c:' || o_custkey",
    "attribute": _choice("(o_orderkey * 5 + k * 3)", ATTRIBUTES),
    "value": "CASE (o_orderkey * 5 + k * 3) % 16 WHEN 0 THEN CAST(1000 + (o_orderkey * 37 + k * 911) % 9000 AS STRING) WHEN 1 THEN CAST(5 + (o_orderkey * 13 + k) % 200 AS STRING)"
    " WHEN 7 THEN CAST((o_orderkey + k) % 6 AS STRING) WHEN 9 THEN CAST(1 + (o_orderkey + k) % 5 AS STRING) WHEN 10 THEN CAST((o_orderkey + k * 17) % 400 AS STRING)"
    f" WHEN 12 THEN {_choice('(o_orderkey + k)', INDUSTRIES)} WHEN 14 THEN '+39 3' || (100000000 + o_orderkey % 5000) WHEN 15 THEN 'c' || o_custkey || '@acme.it'"
    " ELSE CASE (o_orderkey + k) % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'No' END END",
    "age_days": "(o_orderkey * 7 + k * 31) % 397",
    "source": _choice("(o_orderkey + k)", ["audit", "registry", "web"]),
}
_HAPPENED = {
    "id": "event_id",
    "entity_id": "'c:' || user_id",
    "event_type": _choice("event_id", EVENTS),
    "job_title": _choice("(event_id / 7)".replace("/", "%"), JOBS),
    "new_location": "event_id % 4 < 2",
    "age_days": "(event_id * 11) % 401",
    "processed": "event_id % 3 = 0",
}
_RELATED = {
    "id": "o_orderkey",
    "source_id": "'c:' || o_custkey",
    "target_id": "'c:' || ((o_orderkey * 13) % 1400 + 1)",
    "relationship_type": _choice("o_orderkey", LINKS),
    "confidence": "(o_orderkey % 50) / CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)",
    "age_days": "(o_orderkey * 3) % 301",
}


def _sql(columns: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {name}" for name, x in columns.items())


#: The views ``fobs``, ``fev``, ``frel`` and ``fent`` (companies with city and category) for DuckDB.
FACT_SQL = (
    f"WITH fobs AS (SELECT {_sql(_OBSERVED)} FROM orders, (VALUES (0), (1), (2), (3)) v(k)), fev AS (SELECT {_sql(_HAPPENED)} FROM events), "
    f"frel AS (SELECT {_sql(_RELATED)} FROM orders), "
    "fent AS (SELECT 'c:' || c_custkey AS id, c_name AS name, n_name AS city, lower(c_mktsegment) AS category, c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey) "
)


def observations(t: Tables) -> DataFrame:
    rows = t.raw("orders").select("o_orderkey", "o_custkey", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    return rows.select(*[F.expr(x).alias(n) for n, x in _OBSERVED.items()])


def events(t: Tables) -> DataFrame:
    return t.raw("events").select(*[F.expr(x).alias(n) for n, x in _HAPPENED.items()])


def relationships(t: Tables) -> DataFrame:
    return t.raw("orders").select(*[F.expr(x).alias(n) for n, x in _RELATED.items()])


def companies(t: Tables) -> DataFrame:
    rows = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.lower("c_mktsegment").alias("category"), F.col("c_acctbal").alias("balance"))
