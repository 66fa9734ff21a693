"""Deal and lead analytics: closure lift, gap mesh, segment totals, composite index, action rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.functions.columns import clamp, grade, half_up
from lakegraph.functions.leads import is_true, present
from lakegraph.sources.sinks import stored as written


def won() -> Column:
    return F.col("stage") == "vinto"


def closed() -> Column:
    return F.col("stage").isin("vinto", "perso")


def share(part: Column, whole: Column) -> Column:
    return half_up(part * 100.0 / whole)


def closure_patterns(deals: DataFrame, outreach: DataFrame) -> DataFrame:
    """``signal, won, lost, baseline, segment, lift, confidence``: the eight segments with the greatest lift of the win rate.

    Segments need two closed deals, the whole three; without them there is no row. Ties go by name.
    """
    contact = outreach.groupBy("lead").agg(F.bool_or(F.col("status") == "interested").alias("interested"), *(F.bool_or(F.col("channel") == c).alias(c) for c in ("whatsapp", "email")), F.min("day").alias("first_day"))
    ended = deals.where(closed()).join(contact, "lead", "left").withColumn("won", won())
    score = F.col("score")
    tests = {
        "score_hot": score >= 70, "score_warm": (score >= 50) & (score < 70), "outreach_interested": F.col("interested"), "channel_whatsapp": F.col("whatsapp"),
        "channel_email": F.col("email"), "fast_close": F.col("day") - F.col("first_day") <= 14, "all": F.lit(True),
    }
    rows = ended.select("won", F.explode(F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in tests.items())))).alias("signal"))
    groups = rows.groupBy("signal").agg(F.count_if("won").alias("won"), F.count_if(~F.col("won")).alias("lost"))
    n = F.col("won") + F.col("lost")
    rated = groups.withColumn("segment", share(F.col("won"), n).cast("long"))
    base = rated.where(F.col("signal") == "all").where(n >= 3).select(F.col("segment").alias("baseline"))  # one row
    out = rated.where(F.col("signal") != "all").where(n >= 2).join(F.broadcast(base))
    out = out.select("signal", "won", "lost", "baseline", "segment", (F.col("segment") - F.col("baseline")).alias("lift"), F.least(F.lit(0.95), 0.45 + n * 0.08).alias("confidence"))
    return out.orderBy(F.desc("lift"), "signal").limit(8)


def _gaps() -> dict[str, Column]:
    return {
        "no_pixel": ~is_true(F.col("meta_pixel")), "no_gtm": ~is_true(F.col("tag_manager")), "no_email": ~present(F.col("email")), "no_phone": ~present(F.col("phone")),
        "no_website": ~present(F.col("site")), "hot_score": F.col("score") >= 70,
    }


def gap_shares(leads: DataFrame) -> DataFrame:
    """``signal, n, pct`` of every gap that some lead has."""
    counts = leads.agg(F.count("*").alias("total"), *(F.count_if(test).alias(n) for n, test in _gaps().items()))
    rows = counts.select("total", F.explode(F.array(*(F.struct(F.lit(n).alias("signal"), F.col(n).alias("n")) for n in _gaps()))).alias("x"))
    return rows.select("x.signal", "x.n", share(F.col("x.n"), F.col("total")).cast("long").alias("pct")).where("n > 0")


def mesh_groups(leads: DataFrame, by: str, most: int = 8) -> DataFrame:
    g = leads.groupBy(by).agg(
        F.count("*").alias("n"), half_up(F.avg("score")).cast("long").alias("mean_score"), share(F.count_if(_gaps()["no_pixel"]), F.count("*")).cast("long").alias("no_pixel_pct"),
        share(F.count_if(~_gaps()["no_email"]), F.count("*")).cast("long").alias("with_email_pct"),
    )
    return g.orderBy(F.desc("n"), by).limit(most)


def shared_contacts(leads: DataFrame) -> DataFrame:
    """How many phones (digits) and mail addresses stand in two rows and more."""
    def often(key: Column, name: str) -> DataFrame:
        return leads.where(present(F.col(name))).groupBy(key.alias("k")).agg(F.count("*").alias("n")).where("n >= 2").agg(F.count("*").alias(f"{name}s"))

    return often(F.regexp_replace("phone", "[^0-9]", ""), "phone").join(F.broadcast(often(F.lower("email"), "email")))


def segment_stats(leads: DataFrame, by: str = "city") -> DataFrame:
    return leads.groupBy(by).agg(
        F.count("*").alias("total"), half_up(F.avg("score")).cast("long").alias("mean"), F.count_if(present(F.col("email"))).alias("with_email"),
        F.count_if(present(F.col("phone"))).alias("with_phone"), F.count_if(~is_true(F.col("meta_pixel"))).alias("no_pixel"), F.count_if(F.col("ssl").eqNullSafe(False)).alias("no_ssl"),
    )


def mesh_from_stats(stats: DataFrame) -> DataFrame:
    hot = F.sum(F.when(F.col("mean") >= 70, F.col("total")))
    out = stats.agg(F.sum("total").alias("total"), F.sum("no_pixel").alias("no_pixel"), F.sum(F.col("total") - F.col("with_email")).alias("no_email"), hot.alias("hot"))
    return out.withColumn("no_pixel_pct", share(F.col("no_pixel"), F.col("total")).cast("long"))


def top_in_group(rows: DataFrame, group: str, by: str, most: int) -> DataFrame:
    """``group, top_<by>``: the most frequent values as ``value=count``; ties by value. Names end in ``ies`` for ``y``."""
    counts = rows.groupBy(group, by).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), by))).where(F.col("r") <= most)
    listed = F.array_sort(F.collect_list(F.struct("r", F.concat(by, F.lit("="), F.col("n").cast("string")).alias("s"))))
    name = f"top_{by[:-1]}ies" if by.endswith("y") else f"top_{by}s"
    return ranked.groupBy(group).agg(F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias(name))


def best_group(deals: DataFrame, by: str) -> DataFrame:
    """The group with the best win rate, then revenue, then name."""
    g = deals.groupBy(by).agg(F.count_if(closed()).alias("closed"), F.count_if(won()).alias("won"), F.round(F.sum(F.when(won(), F.col("deal_value"))), 2).alias("revenue")).where("closed > 0")
    return g.select(by, share(F.col("won"), F.col("closed")).cast("long").alias("win_rate"), "revenue").orderBy(F.desc("win_rate"), F.desc("revenue"), by).limit(1)


def composite(deals: DataFrame, outreach: DataFrame, leads: DataFrame, knowledge: DataFrame, today: int) -> DataFrame:
    """One row: five components (0 to 100), their weighted score, its grade, and the segment with the greatest lift."""
    p = deals.agg(F.count_if(won()).alias("won"), F.count_if(F.col("stage") == "perso").alias("lost"), F.count_if(~closed()).alias("active"), F.count_if(~closed() & (F.col("day") < today - 7)).alias("stagnant"))
    o = outreach.agg(share(F.count_if(F.col("status").isin("replied", "interested")), F.count("*")).alias("response"), share(F.count_if(F.col("status") == "interested"), F.count("*")).alias("interest"))
    e = leads.agg(F.count_distinct("city").alias("segments"), F.count("*").alias("total"), F.least(F.lit(8), F.count_distinct("category")).alias("groups"))
    k = knowledge.agg(F.count("*").alias("objects"))
    lift = closure_patterns(deals, outreach).where("lift > 0").agg(F.min_by("signal", F.struct((-F.col("lift")).alias("m"), "signal")).alias("top_lift"))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), (o, e, k, lift), p)  # one row each
    win = F.coalesce(F.col("won") * 100.0 / (F.col("won") + F.col("lost")), F.lit(0.0))
    stagnant = F.coalesce(F.col("stagnant") * 100.0 / F.col("active"), F.lit(0.0))
    parts = {
        "conversion": win * 0.55 + F.col("interest") * 0.25 + F.col("response") * 0.2,
        "velocity": F.lit(100) - stagnant * 1.2 + F.least(F.lit(20), F.col("active") * 2),
        "quality": F.col("response") * 0.5 + F.col("interest") * 0.5,
        "coverage": F.least(F.lit(40), F.col("segments") * 8) + F.least(F.lit(35.0), F.col("total") / 2) + F.least(F.lit(25), F.col("groups") * 5),
        "knowledge": F.least(F.lit(100), F.col("objects") * 6),
    }
    row = row.select("top_lift", *(clamp(c).cast("long").alias(n) for n, c in parts.items()))
    weights = {"conversion": 0.3, "velocity": 0.25, "quality": 0.2, "coverage": 0.15, "knowledge": 0.1}
    row = row.withColumn("score", clamp(reduce(Column.__add__, [F.col(n) * w for n, w in weights.items()])).cast("long"))
    return row.withColumn("grade", grade(F.col("score")))


def actions(deals: DataFrame, outreach: DataFrame, leads: DataFrame, signals: DataFrame, today: int) -> DataFrame:
    """``type, severity, n`` of the rules that count something, by severity, then type. One pass over each table."""
    d = deals.agg(
        F.count_if(~closed() & (F.col("day") < today - 7)).alias("stagnant"), F.count_if((F.col("stage") == "proposta") & (F.col("day") < today - 3)).alias("urgent_proposal"),
        F.count_if((F.col("stage") == "nuovo") & (F.col("score") >= 70)).alias("hot_uncontacted"), F.count_if((F.col("stage") == "meeting") & (F.col("day") < today - 5)).alias("stale_meeting"),
    )
    fresh = clamp(F.lit(100.0) - F.col("audited_days") / 30.0 * 100)
    l = leads.agg(F.count_if(F.coalesce(fresh, F.lit(0)) < 50).alias("stale_leads"))
    s = signals.agg(F.count_if((F.col("kind") == "error") & (F.col("confidence") >= 90)).alias("unread_alerts"), F.count_distinct(F.when(F.col("kind") == "purchase", F.col("lead"))).alias("monitored_leads"))
    sent = F.col("status") == "sent"
    o = outreach.agg(F.count_if(sent & (F.col("day") < today - 3)).alias("outreach_followup"), F.count_if(sent & (F.col("channel") == "email") & (F.col("day") > 11000)).alias("sequence_pending"))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), (l, s, o), d)  # one row each
    severity = {
        "stagnant": F.when(F.col("stagnant") >= 3, "critical").otherwise("warning"), "urgent_proposal": F.lit("critical"), "hot_uncontacted": F.lit("warning"), "stale_meeting": F.lit("warning"),
        "stale_leads": F.when(F.col("stale_leads") >= 10, "warning").otherwise("info"), "unread_alerts": F.lit("warning"), "monitored_leads": F.lit("info"), "outreach_followup": F.lit("critical"), "sequence_pending": F.lit("info"),
    }
    rows = row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("type"), c.alias("severity"), F.col(n).alias("n")) for n, c in severity.items()))).alias("x")).select("x.*").where("n > 0")
    return rows.orderBy(F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2), "type")


def adapted_weights(rows: DataFrame, factors: dict[str, tuple[Column, float]], good: Column, bad: Column) -> DataFrame:
    """``factor, weight``: four percent up or down where the means of good and bad rows are eight apart and more.

    Needs five rows, two on each side; weights stay between 3 and 45.
    """
    values = F.array(*(F.struct(F.lit(n).alias("factor"), c.cast("double").alias("v"), F.lit(w).alias("w")) for n, (c, w) in factors.items()))
    long = rows.select(good.alias("good"), bad.alias("bad"), F.explode(values).alias("x")).select("good", "bad", "x.*").where("v is not null")
    s = long.groupBy("factor", "w").agg(F.count("*").alias("n"), F.count_if("good").alias("np"), F.count_if("bad").alias("nn"), F.avg(F.when(F.col("good"), F.col("v"))).alias("p"), F.avg(F.when(F.col("bad"), F.col("v"))).alias("m"))
    still = (F.col("n") < 5) | (F.col("np") < 2) | (F.col("nn") < 2) | (F.abs(F.col("p") - F.col("m")) < 8)
    change = F.when(still, 1.0).when(F.col("p") > F.col("m"), 1.04).otherwise(0.96)
    return s.select("factor", F.greatest(F.lit(3.0), F.least(F.lit(45.0), F.col("w") * change)).alias("weight"))


def counted_back(rows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """``rows`` with ``n``: how many rows of the same ``key`` have a whole number ``at`` from ``width`` before the row's own up to it.

    A row adds one at its number and takes it away just after the width, so that ``n`` is a running sum, also where
    the width holds a great share of the rows. The sums are cut by ranges of (key, number), so that one key may have any share
    too; a range hands on one sum for each key. Rows without number count each other, rows without key are a key.
    """
    own = rows.groupBy(F.col(key).alias("_key"), F.col(at).alias("_at")).agg(F.count("*").alias("_n"))
    dated = own.where("_at is not null")
    moves = dated.unionByName(dated.select("_key", (F.col("_at") + width + 1).alias("_at"), (-F.col("_n")).alias("_n"))).groupBy("_key", "_at").agg(F.sum("_n").alias("_n"))
    laid = written(moves.repartitionByRange("_key", "_at").withColumn("_range", F.spark_partition_id()), "counted-back")
    here = Window.partitionBy("_key", "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    handed = laid.groupBy(F.col("_key").alias("_k"), F.col("_range").alias("_r")).agg(F.sum("_n").alias("_n"))
    handed = handed.select("_k", "_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    sums = laid.withColumn("_own", F.sum("_n").over(here)).join(handed, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")))
    sums = sums.select("_key", "_at", (F.col("_own") + F.col("_before")).alias("n")).unionByName(own.where("_at is null").withColumnRenamed("_n", "n"))
    return rows.join(sums, F.col(key).eqNullSafe(F.col("_key")) & F.col(at).eqNullSafe(F.col("_at")), "left").drop("_key", "_at")
