"""Leads (open company records with audit results) and their signals, bound to the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph.sources.tables import Tables

AUDITED_BEFORE = "2001-08-02"

#: One expression for each field, in the SQL that both engines share.
_FIELDS = {
    "id": "'c:' || c_custkey",
    "name": "c_name",
    "phone": "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'N/D' ELSE '+39 3' || lpad(CAST(c_custkey % 400 AS STRING), 9, '0') END",
    "email": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'info@example.com' WHEN 2 THEN 'c' || c_custkey || '@acme' || (c_custkey % 50) || '.it' ELSE 'N/D' END",
    "site": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'N/D' ELSE 'https://www.shop' || (c_custkey % 300) || '.it/home' END",
    "instagram": "CASE c_custkey % 3 WHEN 0 THEN '@c' || c_custkey WHEN 1 THEN 'N/D' END",
    "city": "n_name",
    "category": "c_mktsegment",
    "rating": "CASE WHEN c_custkey % 7 > 0 THEN (20 + c_custkey % 31) / CAST(10 AS DOUBLE) END",
    "reviews": "c_custkey % 40",
    "load_seconds": "CASE WHEN c_custkey % 9 > 0 THEN (c_custkey % 60) / CAST(10 AS DOUBLE) END",
    "meta_pixel": "CASE c_custkey % 3 WHEN 1 THEN true WHEN 2 THEN false END",
    "tag_manager": "CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false END",
    "ssl": "CASE c_custkey % 5 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END",
    "mobile": "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 3 THEN false ELSE true END",
    "seo_errors": "CASE c_custkey % 10 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END",
    "dmarc": "CASE c_custkey % 8 WHEN 0 THEN NULL WHEN 5 THEN false ELSE true END",
    "employees": "CASE WHEN c_custkey % 8 > 0 THEN c_custkey % 120 END",
    "revenue": "CASE WHEN c_custkey % 11 > 0 THEN c_acctbal * 1000 END",
    "founded": "CASE WHEN c_custkey % 13 > 0 THEN (1950 + c_custkey % 70) || '-01-01' END",
    "score": "c_custkey % 101",
    "audited_days": "CASE WHEN c_custkey % 6 <> 2 THEN c_custkey % 120 END",
    "google_ads": "CASE c_custkey % 4 WHEN 3 THEN true WHEN 2 THEN false END",
    "analytics": "CASE c_custkey % 5 WHEN 2 THEN true WHEN 4 THEN false END",
    "facebook": "CASE c_custkey % 4 WHEN 1 THEN 'fb' || c_custkey WHEN 2 THEN 'N/D' END",
    "linkedin": "CASE c_custkey % 6 WHEN 1 THEN 'https://www.linkedin.com/company/C' || c_custkey || '/' WHEN 2 THEN 'https://linkedin.com/in/p' || c_custkey WHEN 3 THEN 'linkedin c' END",
    "vat": "CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS STRING), 11, '0') END",
    "copyright_year": "CASE WHEN c_custkey % 4 > 0 THEN 1994 + c_custkey % 9 END",
    "address": "'Via ' || c_custkey || ', ' || (20100 + c_custkey % 50) || ' ' || n_name",
    "forms": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 3 END",
    "clickable": "c_custkey % 4 = 0",
    "performance": "CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 100 END",
    "active_ads": "CASE WHEN c_custkey % 6 = 4 THEN c_custkey % 9 END",
    "pending": "c_custkey % 17 = 0",
    "has_wordpress": "c_custkey % 2 = 0",
    "has_shopify": "c_custkey % 5 = 3",
    "has_ga4": "c_custkey % 3 = 0",
}

#: The view ``lead`` (fields, and ``tech_stack`` as a list) and the view ``sig`` for DuckDB.
LEAD_SQL = (
    "WITH lead AS (SELECT "
    + ", ".join(f"{sql} AS {name}" for name, sql in _FIELDS.items())
    + ", list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'wordpress' END, CASE WHEN c_custkey % 5 = 3 THEN 'shopify' END, CASE WHEN c_custkey % 3 = 0 THEN 'ga4' END], lambda x: x IS NOT NULL) AS tech_stack"
    + " FROM customer JOIN nation ON c_nationkey = n_nationkey), "
    "sig AS (SELECT event_id AS id, 'c:' || user_id AS lead, event_type AS kind, 10 + event_id % 91 AS confidence, event_id % 200 AS age_hours,"
    " CASE event_id % 4 WHEN 0 THEN 'official' WHEN 1 THEN 'aggregator' WHEN 2 THEN 'inferred' END AS tier, ts AS seen_at FROM events) "
)


def leads(t: Tables) -> DataFrame:
    """One row for each customer; a small table of nations is joined, its size (25 rows) is fixed by the source."""
    rows = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tools = [("has_wordpress", "wordpress"), ("has_shopify", "shopify"), ("has_ga4", "ga4")]
    stack = F.array_compact(F.array(*[F.when(F.col(flag), name) for flag, name in tools]))
    return rows.select(*[F.expr(sql).alias(name) for name, sql in _FIELDS.items()]).withColumn("tech_stack", stack)


def signals(t: Tables) -> DataFrame:
    """One row for each event: what was seen about a lead, how surely, how long ago and by what tier of source."""
    n = F.col("event_id")
    tier = F.when(n % 4 == 0, "official").when(n % 4 == 1, "aggregator").when(n % 4 == 2, "inferred")
    return t.raw("events").select(n.alias("id"), F.concat(F.lit("c:"), "user_id").alias("lead"), F.col("event_type").alias("kind"), (n % 91 + 10).alias("confidence"), (n % 200).alias("age_hours"), tier.alias("tier"), F.col("ts").alias("seen_at"))
