"""Parquet tables bound to the knowledge-graph model: entities, observations, relationships, events, deals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy frames over one folder of Parquet tables; Catalyst prunes columns and pushes filters into the scans."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def entities(self) -> DataFrame:
        nation = self.raw("nation")
        seen = self.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_seen_at"))
        none = F.lit(None).cast("string")
        c = self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(seen, "c_custkey", "left")
        c = c.select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit("company").alias("entity_type"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("c_mktsegment").alias("category"), ((F.col("c_custkey") % 50) / 100.0 + 0.5).alias("confidence"), "last_seen_at", none.alias("merged_into_id"))
        k = F.col("s_suppkey")
        s = self.raw("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        s = s.select(F.concat(F.lit("s:"), k).alias("id"), F.lit("company").alias("entity_type"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.lit("SUPPLIER").alias("category"), F.lit(0.9).alias("confidence"), F.lit(None).cast("timestamp").alias("last_seen_at"), F.when((k % 10).isin(7, 8), F.concat(F.lit("s:"), k + 1)).alias("merged_into_id"))
        n = nation.select(F.concat(F.lit("n:"), "n_nationkey").alias("id"), F.lit("location").alias("entity_type"), F.col("n_name").alias("name"), none.alias("city"), none.alias("category"), F.lit(1.0).alias("confidence"), F.lit(None).cast("timestamp").alias("last_seen_at"), none.alias("merged_into_id"))
        return c.unionByName(s).unionByName(n)

    def observations(self) -> DataFrame:
        o = self.raw("orders")
        both = F.array(
            F.struct(F.lit("revenue").alias("attribute"), F.lit(None).cast("string").alias("value_text"), F.col("o_totalprice").alias("value_num")),
            F.struct(F.lit("status").alias("attribute"), F.col("o_orderstatus").alias("value_text"), F.lit(None).cast("double").alias("value_num")),
        )
        o = o.select("o_orderkey", F.concat(F.lit("c:"), "o_custkey").alias("entity_id"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderpriority").alias("source"), F.explode(both).alias("x"))
        return o.select(F.concat_ws(":", F.lit("o"), "o_orderkey", "x.attribute").alias("id"), "entity_id", "x.attribute", "x.value_text", "x.value_num", "observed_at", "source")

    def relationships(self) -> DataFrame:
        pairs = self.raw("lineitem").join(self.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("observed_at"))
        sells = pairs.select(F.concat(F.lit("s:"), "l_suppkey").alias("source_id"), F.concat(F.lit("c:"), "o_custkey").alias("target_id"), F.lit("sells_to").alias("relationship_type"), F.least(F.lit(1.0), F.col("n") * 0.125 + 0.5).alias("confidence"), "observed_at")
        when = F.lit("2001-01-01").cast("timestamp")
        at = [("customer", "c", "c_custkey", "c_nationkey"), ("supplier", "s", "s_suppkey", "s_nationkey")]
        located = [self.raw(t).select(F.concat(F.lit(f"{p}:"), k).alias("source_id"), F.concat(F.lit("n:"), n).alias("target_id"), F.lit("located_in").alias("relationship_type"), F.lit(1.0).alias("confidence"), when.alias("observed_at")) for t, p, k, n in at]
        return sells.unionByName(located[0]).unionByName(located[1])

    def events(self) -> DataFrame:
        return self.raw("events").select(F.col("event_id").alias("id"), F.concat(F.lit("c:"), "user_id").alias("entity_id"), "event_type", F.col("props").alias("payload"), F.col("value"), F.col("ts").alias("occurred_at"), (F.col("event_id") % 3 == 0).alias("processed"))

    def deals(self) -> DataFrame:
        stage = F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "P", "lost").otherwise("active")
        o = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("lead"), stage.alias("stage"), F.col("o_totalprice").alias("deal_value"), (F.col("o_orderkey") % 101).alias("score"), F.col("o_orderdate").alias("updated_at"), F.col("c_mktsegment").alias("category"), F.col("n_name").alias("city"))


#: The same binding as SQL views, for the oracles.
BINDING_SQL = """
WITH ent AS (
  SELECT 'c:' || c_custkey AS id, 'company' AS entity_type, c_name AS name, n_name AS city, c_mktsegment AS category, (c_custkey % 50) / 100.0::DOUBLE + 0.5::DOUBLE AS confidence,
         (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_seen_at, NULL::VARCHAR AS merged_into_id FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's:' || s_suppkey, 'company', s_name, n_name, 'SUPPLIER', 0.9, NULL, CASE WHEN s_suppkey % 10 IN (7, 8) THEN 's:' || (s_suppkey + 1) END FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n:' || n_nationkey, 'location', n_name, NULL, NULL, 1.0, NULL, NULL FROM nation
), obs AS (
  SELECT 'o:' || o_orderkey || ':revenue' AS id, 'c:' || o_custkey AS entity_id, 'revenue' AS attribute, NULL::VARCHAR AS value_text, o_totalprice AS value_num, o_orderdate AS observed_at, o_orderpriority AS source FROM orders
  UNION ALL SELECT 'o:' || o_orderkey || ':status', 'c:' || o_custkey, 'status', o_orderstatus, NULL, o_orderdate, o_orderpriority FROM orders
), rel AS (
  SELECT 's:' || l_suppkey AS source_id, 'c:' || o_custkey AS target_id, 'sells_to' AS relationship_type, least(1.0::DOUBLE, count(*) * 0.125::DOUBLE + 0.5::DOUBLE) AS confidence, max(l_shipdate) AS observed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey, o_custkey
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'located_in', 1.0, TIMESTAMP '2001-01-01' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'located_in', 1.0, TIMESTAMP '2001-01-01' FROM supplier
), ev AS (
  SELECT event_id AS id, 'c:' || user_id AS entity_id, event_type, props AS payload, value, ts AS occurred_at, event_id % 3 = 0 AS processed FROM events
), deals AS (
  SELECT o_orderkey AS id, o_custkey AS lead, CASE o_orderstatus WHEN 'F' THEN 'won' WHEN 'P' THEN 'lost' ELSE 'active' END AS stage, o_totalprice AS deal_value, o_orderkey % 101 AS score, o_orderdate AS updated_at, c_mktsegment AS category, n_name AS city
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)
"""
