"""Entities and records over time: merges, upserts, audits, accumulated results, changes, source health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.functions.leads import present, twin_opportunity


def moved(rows: DataFrame, column: str, final: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the end of its merge chain; ids that are no entity stay."""
    ends = final.select(F.col("id").alias("_id"), F.col("final_id").alias("_end"))
    return rows.join(ends, F.col(column) == F.col("_id"), "left").withColumn(column, F.coalesce("_end", column)).drop("_id", "_end")


def merged_edges(edges: DataFrame, final: DataFrame) -> DataFrame:
    """Edges between kept entities: self-loops go, of equal edges the surest stays."""
    both = moved(moved(edges, "source_id", final), "target_id", final).where("source_id <> target_id")
    return both.groupBy("source_id", "target_id", "relationship_type").agg(F.max("confidence").alias("confidence"))


def upsert_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """``id, metadata, is_new`` of both sides (unique ids): maps are merged, the new side's keys win."""
    a, b = old.select(F.col("id").alias("_a"), F.col("metadata").alias("_old")), new.select(F.col("id").alias("_b"), F.col("metadata").alias("_new"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full")
    kept = F.map_filter("_old", lambda k, v: ~F.map_contains_key("_new", k))
    merged = F.when(F.col("_new").isNull(), F.col("_old")).when(F.col("_old").isNull(), F.col("_new")).otherwise(F.map_concat(kept, "_new"))
    return both.select(F.coalesce("_a", "_b").alias("id"), merged.alias("metadata"), F.col("_a").isNull().alias("is_new"))


def audited(leads: DataFrame, audits: DataFrame) -> DataFrame:
    """Leads with their audit (``id, has_pixel, has_gtm, email, phone``): flags are replaced, real contacts stay, freshness is 100."""
    a = audits.select("id", F.col("has_pixel").alias("_pixel"), F.col("has_gtm").alias("_gtm"), F.col("email").alias("_email"), F.col("phone").alias("_phone"), F.lit(100).alias("freshness"))
    rows = leads.join(a, "id", "left")
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", ""))
    return rows.withColumns({
        "meta_pixel": F.coalesce("_pixel", "meta_pixel"),
        "tag_manager": F.coalesce("_gtm", "tag_manager"),
        "email": F.when(F.contains("email", F.lit("@")), F.col("email")).otherwise(F.coalesce("_email", "email")),
        "phone": F.when(digits >= 8, F.col("phone")).otherwise(F.coalesce("_phone", "phone")),
    }).drop("_pixel", "_gtm", "_email", "_phone")


def twins(leads: DataFrame, signals: DataFrame) -> DataFrame:
    """One row for each company: score, technologies, events, and the edges of its star (technologies and its place)."""
    events = signals.groupBy(F.col("lead").alias("id")).agg(F.count("*").alias("events"))
    rows = leads.join(events, "id", "left").withColumn("events", F.coalesce("events", F.lit(0)))
    tech = F.array_join(F.array_sort("tech_stack"), ",")
    return rows.select("id", "name", twin_opportunity().alias("opportunity"), tech.alias("tech"), "events", F.least(F.lit(20), "events").alias("shown"), (F.size("tech_stack") + 1).cast("long").alias("edges"))


def star_edges(rows: DataFrame, segment: str, category: str, part: str, most: int) -> DataFrame:
    """``from_id, to_id, weight``: segments to their parts, and to their largest categories by share of the largest."""
    center = F.concat(F.lit("env:"), segment)
    counts = rows.groupBy(segment, category).agg(F.count("*").alias("n"))
    w = Window.partitionBy(segment)
    ranked = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), category))).withColumn("top", F.max("n").over(w)).where(F.col("r") <= most)
    name = F.concat(F.lit("cat:"), F.regexp_replace(F.lower(category), r"\s+", "-"))
    cats = ranked.select(center.alias("from_id"), name.alias("to_id"), (F.col("n") / F.col("top")).alias("weight"))
    lists = rows.groupBy(segment, part).agg(F.count("*").alias("n"))
    return cats.unionByName(lists.select(center.alias("from_id"), F.concat(F.lit("list:"), F.col(part).cast("string")).alias("to_id"), F.col("n").cast("double").alias("weight")))


def accumulated(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """``key, id, seen``: each key once, in order of its first row, with its newest row's id; at most ``most`` keys are shown."""
    g = rows.groupBy(key).agg(F.max_by("id", order).alias("id"), F.count("*").alias("seen"), F.min(order).alias("_first"))
    return g.orderBy("_first").limit(most).drop("_first")


def changes(snapshots: DataFrame, flags: list[str], number: str, least: float = 0.3) -> DataFrame:
    """``id, change`` (``name+`` or ``name-``) between an entity's snapshots: flags, a number that moves by ``least``, the site's status.

    A first snapshot has nothing to differ from; a null number doesn't differ.
    """
    w = Window.partitionBy("entity").orderBy("at", "id")
    rows = snapshots.withColumn("_before", F.lag(F.struct(*flags, number)).over(w)).where("_before is not null")

    def sign(up: Column, name: str) -> Column:
        return F.concat(F.lit(name), F.when(up, "+").otherwise("-"))

    def flag(c: str, name: str) -> Column:
        return F.when(F.col(f"_before.{c}") != F.col(c), sign(F.col(c), name))

    step = F.col(number) - F.col(f"_before.{number}")
    found = [flag(c, c) for c in flags] + [F.when(F.abs(step) >= least - 1e-9, sign(step > 0, number))] + ([flag("site", "website_status")] if "site" in flags else [])
    return rows.select("id", F.explode(F.array_compact(F.array(*found))).alias("change"))


def breaker(calls: DataFrame, source: str, most: int = 3, rest: int = 300) -> DataFrame:
    """``failures`` in a row after each call (``at`` seconds, ``ok``), and ``tried``: whether the call was due.

    After ``most`` failures a source rests for ``rest`` seconds from its last failure.
    """
    order = Window.partitionBy(source).orderBy("at", "id")
    runs = calls.withColumn("_island", F.count_if("ok").over(order))
    run = Window.partitionBy(source, "_island").orderBy("at", "id")
    counted = runs.withColumn("failures", F.count_if(~F.col("ok")).over(run))
    before, since = F.coalesce(F.lag("failures").over(order), F.lit(0)), F.col("at") - F.lag("at").over(order)
    return counted.withColumn("tried", (before < most) | (since > rest)).drop("_island")


def exponential_mean(rows: DataFrame, source: str, value: str, order: list[str], keep: float) -> DataFrame:
    """``source, mean``: each value moves the mean by ``1 - keep`` of the difference, from 0; as a weighted sum from the newest back."""
    w = Window.partitionBy(source).orderBy(*[F.desc(c) for c in order])
    back = rows.withColumn("_back", F.row_number().over(w) - 1)
    return back.groupBy(source).agg(F.sum(F.col(value) * (1 - keep) * F.pow(F.lit(keep), F.col("_back"))).alias("mean"))


def known_contacts(rows: DataFrame) -> Column:
    """Whether a row has a phone or a mail address that mean something."""
    return present(F.col("phone")) | present(F.col("email"))
