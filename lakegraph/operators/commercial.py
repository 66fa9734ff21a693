"""Commercial signals of companies: what recent observations, events and relationships say, counted once for each company."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.functions.columns import clamp, half_up, to_bool

RECENT_DAYS = 180
# Weight of each signal.
WEIGHTS = {"growth": 1.0, "buying": 1.25, "digital_transformation": 1.1, "budget": 1.0, "urgency": 0.9, "pain": 0.85, "intent_fit": 1.15}
# Attributes that tell of tools in use, and those whose lack is a pain.
TECH = ["google_tag_manager", "meta_pixel", "google_analytics", "chatbot", "booking", "has_chatbot", "has_booking", "has_ecommerce"]
PAINS = ["ssl", "mobile_friendly", "has_chatbot", "has_booking", "meta_pixel", "google_tag_manager"]
MARKETING_JOB = "(?i)marketing|digital|growth|cmo|web"


def observed_counts(observations: DataFrame, has: tuple[str, ...] = (), missing: tuple[str, ...] = ()) -> DataFrame:
    """One row for each entity: counts over its recent observations; newest first, of equal age the greater id."""
    newest = Window.partitionBy("entity_id", "attribute").orderBy("age_days", F.desc("id"))
    o = observations.where(F.col("age_days") <= RECENT_DAYS).withColumn("r", F.row_number().over(newest))
    o = o.withColumn("n", F.col("value").try_cast("double")).withColumn("b", to_bool(F.col("value")))
    attribute, first = F.col("attribute"), F.col("r") == 1

    def value(name: str, r: int) -> Column:
        return F.max(F.when((attribute == name) & (F.col("r") == r), F.col("n"))).alias(f"{name}_{r}")

    def count(name: str, test: Column) -> Column:
        return F.count_if(test).alias(name)

    wants = [(attribute == x) & first & F.col("b") for x in has] + [(attribute == x) & first & ~F.col("b") for x in missing]
    return o.groupBy("entity_id").agg(
        *(count(f"{x}_n", attribute == x) for x in ("revenue", "employees")),
        *(value(x, r) for x in ("revenue", "employees") for r in (1, 2)),
        count("tools", attribute.isin(TECH) & F.col("b")),
        count("invests", (attribute == "investing_marketing") & F.col("b")),
        count("unaudited", (attribute == "last_audited_at") & (F.col("n") > 180)),
        count("low_ratings", (attribute == "rating") & (F.col("n") < 4)),
        count("pains", attribute.isin(PAINS) & first & ~F.col("b")),
        count("slow", (attribute == "load_speed_seconds") & first & (F.col("n") > 3)),
        count("seo", (attribute == "seo_disaster") & first & F.col("b")),
        count("wanted_tools", reduce(Column.__or__, wants, F.lit(False))),
    )


def event_counts(events: DataFrame) -> DataFrame:
    """One row for each entity: recent events by what they tell; of registry changes the two newest are looked at."""
    newest = Window.partitionBy("entity_id", "event_type").orderBy("age_days", F.desc("id"))
    e = events.where(F.col("age_days") <= RECENT_DAYS).withColumn("r", F.row_number().over(newest))
    kind = F.col("event_type")
    groups = {
        "hirings": kind == "new_hiring",
        "expansions": kind.isin("expansion_started", "market_entered"),
        "tenders": kind == "tender_won",
        "sought": kind == "supplier_sought",
        "moves": (kind == "registry_change") & (F.col("r") <= 2) & F.col("new_location"),
        "crms": kind.isin("crm_installed", "crm_change"),
        "renewals": kind == "website_changed",
        "marketing_jobs": (kind == "new_hiring") & F.col("job_title").rlike(MARKETING_JOB),
        "funded": kind == "funding_received",
        "ads": kind.isin("ads_started", "pixel_installed"),
        "directors": kind.isin("new_director", "executive_change"),
    }
    return e.groupBy("entity_id").agg(*(F.count_if(test).alias(n) for n, test in groups.items()))


def link_counts(relationships: DataFrame) -> DataFrame:
    r = relationships.where(F.col("age_days") <= RECENT_DAYS)
    return r.groupBy(F.col("source_id").alias("entity_id")).agg(*(F.count_if(F.col("relationship_type") == k).alias(n) for k, n in (("located_in", "places"), ("awarded_to", "awards"))))


def facts(companies: DataFrame, observations: DataFrame, events: DataFrame, relationships: DataFrame, has: tuple[str, ...] = (), missing: tuple[str, ...] = ()) -> DataFrame:
    """Companies (``id``, city, category) with all counts; those without facts have zeros. Each side is aggregated before its join."""
    newest = observations.where("attribute = 'category'").groupBy("entity_id").agg(F.max_by("value", F.struct(-F.col("age_days"), "id")).alias("observed_category"))
    out = companies
    for side in (observed_counts(observations, has, missing), event_counts(events), link_counts(relationships), newest):
        out = out.join(side.withColumnRenamed("entity_id", "id"), "id", "left")
    counted = [f.name for f in out.schema if f.name not in companies.columns and f.name not in ("observed_category", "revenue_1", "revenue_2", "employees_1", "employees_2")]
    return out.fillna(0, counted)


def at_most(n: int, name: str) -> Column:
    return F.least(F.lit(n), F.col(name))


def grew(name: str) -> Column:
    """Newest value over five percent above the one before."""
    now, before = F.col(f"{name}_1"), F.col(f"{name}_2")
    return F.coalesce((before > 0) & (now - before > before * 0.05), F.lit(False)).cast("int")


def signals(counted: DataFrame, cities: tuple[str, ...] = (), industries: tuple[str, ...] = ()) -> DataFrame:
    """``id, type, score, confidence, evidence`` of every signal with some evidence, from ``facts``."""
    city, category = F.lower(F.coalesce("city", F.lit(""))), F.coalesce("observed_category", F.lit(""))
    fits = [reduce(Column.__or__, [F.contains(city, F.lit(c.lower())) for c in cities], F.lit(False))]
    fits.append(reduce(Column.__or__, [F.contains(F.coalesce("category", F.lit("")), F.lit(x)) | F.contains(category, F.lit(x)) for x in industries], F.lit(False)))
    places, expands = (F.col("places") > 0).cast("int"), (F.col("expansions") > 0) | (F.col("places") > 1)
    n = {
        "growth": at_most(3, "hirings") + grew("revenue") + grew("employees") + F.col("expansions") + places,
        "buying": at_most(3, "tenders") + at_most(2, "sought") + F.col("moves") + at_most(2, "awards"),
        "digital_transformation": F.col("tools") + F.col("crms") + at_most(2, "renewals") + at_most(2, "marketing_jobs"),
        "budget": at_most(2, "funded") + at_most(2, "ads") + F.col("invests"),
        "urgency": F.col("unaudited") + at_most(2, "directors") + F.col("low_ratings"),
        "pain": F.col("pains") + F.col("slow") + F.col("seo"),
        "intent_fit": fits[0].cast("int") + fits[1].cast("int") + F.col("wanted_tools"),
    }
    two = [F.when(F.col(f"{x}_n") >= 2, 25).otherwise(0) for x in ("revenue", "employees")]
    score = {
        "growth": F.least(F.lit(45), 25 * at_most(3, "hirings")) + two[0] + two[1] + F.when(expands, 20).otherwise(0),
        "buying": F.least(F.lit(95), 40 * F.least(F.lit(3), F.col("tenders") + F.col("sought") + F.col("awards"))),
        "digital_transformation": 20 + 18 * n["digital_transformation"],
        "budget": 25 + 25 * n["budget"],
        "urgency": 20 + 25 * n["urgency"],
        "pain": 20 + 16 * n["pain"],
        "intent_fit": 30 + 18 * n["intent_fit"],
    }
    # Confidence without evidence, for each piece of evidence, and at most.
    sure = {"growth": (0.6, 0.08, 0.95), "buying": (0.65, 0.07, 0.95), "digital_transformation": (0.65, 0.06, 0.95), "budget": (0.65, 0.08, 0.95), "urgency": (0.6, 0.08, 0.9), "pain": (0.6, 0.06, 0.9), "intent_fit": (0.65, 0.07, 0.95)}

    def one(kind: str) -> Column:
        base, each, most = sure[kind]
        confidence = F.least(F.lit(most), F.lit(base) + n[kind] * each)
        return F.struct(F.lit(kind).alias("type"), F.least(F.lit(100), score[kind]).cast("long").alias("score"), confidence.alias("confidence"), n[kind].cast("long").alias("evidence"))

    rows = counted.select("id", F.explode(F.array(*(one(k) for k in WEIGHTS))).alias("s")).select("id", "s.*")
    return rows.where("evidence > 0")


def strength(found: DataFrame) -> DataFrame:
    """``id, strength``: mean score, weighed by the signal's weight and its confidence to four places.

    Both sums go in the order of ``WEIGHTS``, so that a mean at a half falls to the same side however the rows are dealt out.
    """
    kinds = list(WEIGHTS)
    weight = F.round("confidence", 4) * F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])[F.col("type")]
    one = F.struct(F.array_position(F.array(*map(F.lit, kinds)), F.col("type")).alias("at"), (F.col("score") * weight).alias("part"), weight.alias("weight"))
    ordered = found.groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("s"))

    def total(field: str) -> Column:
        return F.aggregate("s", F.lit(0.0), lambda sum_, x: sum_ + x[field])

    return ordered.select("id", half_up(total("part") / total("weight")).cast("long").alias("strength"))


def boosted(score: Column, boost: Column) -> Column:
    return clamp(score + F.coalesce(boost, F.lit(0))).cast("long")


def subgraph_score(hops: Column, confidence: Column, age_days: Column, city: Column, text: Column, cities: tuple[str, ...], industries: tuple[str, ...]) -> Column:
    """Score of a path's end: hops, mean confidence, age of the newest hop, and fit. An empty city fits every place."""
    c = F.lower(F.coalesce(city, F.lit("")))
    place = reduce(Column.__or__, [F.contains(c, F.lit(x.lower())) | F.contains(F.lit(x.lower()), c) for x in cities], F.lit(False))
    trade = reduce(Column.__or__, [F.contains(F.lower(text), F.lit(x)) for x in industries], F.lit(False))
    fresh = F.when(age_days <= 30, 15).when(age_days <= 90, 8).when(age_days.isNotNull(), 3).otherwise(0)
    score = F.lit(35) + F.least(F.lit(30), hops * 15) + half_up(confidence * 20) + fresh + F.when(place, 8).otherwise(0) + F.when(trade, 7).otherwise(0)
    return F.least(F.lit(100), score).cast("long")
