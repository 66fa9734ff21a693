"""From lead rows to the graph's tables, and upserts of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph.functions.columns import canonical_company, slug_location, slug_technology

#: Fields that become observations.
OBSERVED = ["rating", "employees", "revenue", "load_seconds"]


def ingest(leads: DataFrame) -> dict[str, DataFrame]:
    """``entities, relationships, observations`` of leads that have an identity.

    A lead is its domain, else its phone. Leads of one identity become one entity (least name); technologies and
    cities are entities of their own, linked by ``uses`` and ``located_in``. Null values give no observation.
    """
    site = F.when(~F.col("site").isin("N/D", ""), F.col("site"))
    known = leads.withColumn("entity_id", canonical_company(site, F.lit(None).cast("string"), F.col("phone"))).where("entity_id is not null")
    known = known.withColumn("place", slug_location(F.col("city"), F.lit("IT")))
    uses = known.select("entity_id", F.explode("tech_stack").alias("tool")).select("entity_id", F.concat(F.lit("tech:"), slug_technology(F.col("tool"))).alias("target_id"), "tool").distinct()
    companies = known.groupBy(F.col("entity_id").alias("id")).agg(F.min("name").alias("name"), F.count("*").alias("leads")).withColumn("entity_type", F.lit("company"))
    tools = uses.groupBy(F.col("target_id").alias("id")).agg(F.min("tool").alias("name"), F.count("*").alias("leads")).withColumn("entity_type", F.lit("technology"))
    places = known.where("place is not null").groupBy(F.col("place").alias("id")).agg(F.min("city").alias("name"), F.count("*").alias("leads")).withColumn("entity_type", F.lit("location"))
    located = known.where("place is not null").select(F.col("entity_id").alias("source_id"), F.col("place").alias("target_id"), F.lit("located_in").alias("relationship_type")).distinct()
    values = F.array(*[F.struct(F.lit(f).alias("attribute"), F.col(f).cast("double").alias("value")) for f in OBSERVED])
    seen = known.select("entity_id", F.explode(values).alias("x")).where("x.value is not null").select("entity_id", "x.attribute", "x.value").distinct()
    return {
        "entities": companies.unionByName(tools).unionByName(places),
        "relationships": uses.select(F.col("entity_id").alias("source_id"), "target_id", F.lit("uses").alias("relationship_type")).unionByName(located),
        "observations": seen,
    }


def upsert_entities(old: DataFrame, new: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """Both tables by key; new values win where they aren't null; ``is_new`` marks keys that only ``new`` has. Keys are unique on each side."""
    a, b = old.select(F.col(key).alias("_a"), *[F.col(f).alias(f"_a_{f}") for f in fields]), new.select(F.col(key).alias("_b"), *[F.col(f).alias(f"_b_{f}") for f in fields])
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    return both.select(F.coalesce("_a", "_b").alias(key), *[F.coalesce(f"_b_{f}", f"_a_{f}").alias(f) for f in fields], F.col("_a").isNull().alias("is_new"))
