"""Queries over typed facts: commercial signals, ranking, lead projection, summaries; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph import catalog
from lakegraph.functions import columns as C
from lakegraph.operators import analytics as A
from lakegraph.operators import commercial as K
from lakegraph.operators import graph
from lakegraph.sources import facts as B
from lakegraph.sources.tables import Tables


def query(name: str, sql: str | None = None):
    return catalog.query(name, B.FACT_SQL + sql if sql else None, bound=False)


# Commercial signals

CITIES, INDUSTRIES, HAS, MISSING = ("nation_1",), ("building", "legal"), ("meta_pixel",), ("google_tag_manager",)

#: One row for each company with all counts.
COUNTS_SQL = """, ro AS (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute ORDER BY age_days, id DESC) AS r, TRY_CAST(value AS DOUBLE) AS n,
  CASE WHEN lower(value) IN ('true', 'yes', 'si', '1') THEN true WHEN lower(value) IN ('false', 'no', '0') THEN false END AS b FROM fobs WHERE age_days <= 180
), oc AS (SELECT entity_id, count(*) FILTER (attribute = 'revenue') AS rev_n, count(*) FILTER (attribute = 'employees') AS emp_n,
  max(n) FILTER (attribute = 'revenue' AND r = 1) AS rev1, max(n) FILTER (attribute = 'revenue' AND r = 2) AS rev2, max(n) FILTER (attribute = 'employees' AND r = 1) AS emp1, max(n) FILTER (attribute = 'employees' AND r = 2) AS emp2,
  count(*) FILTER (b AND attribute IN ('google_tag_manager', 'meta_pixel', 'has_chatbot', 'has_booking')) AS tools, count(*) FILTER (b AND attribute = 'investing_marketing') AS invests,
  count(*) FILTER (attribute = 'last_audited_at' AND n > 180) AS unaudited, count(*) FILTER (attribute = 'rating' AND n < 4) AS low,
  count(*) FILTER (r = 1 AND NOT b AND attribute IN ('ssl', 'mobile_friendly', 'has_chatbot', 'has_booking', 'meta_pixel', 'google_tag_manager'))
  + count(*) FILTER (r = 1 AND attribute = 'load_speed_seconds' AND n > 3) + count(*) FILTER (r = 1 AND b AND attribute = 'seo_disaster') AS pain,
  count(*) FILTER (r = 1 AND (attribute = 'meta_pixel' AND b OR attribute = 'google_tag_manager' AND NOT b)) AS tech FROM ro GROUP BY entity_id
), re AS (SELECT *, row_number() OVER (PARTITION BY entity_id, event_type ORDER BY age_days, id DESC) AS r FROM fev WHERE age_days <= 180
), ec AS (SELECT entity_id, count(*) FILTER (event_type = 'new_hiring') AS hire, count(*) FILTER (event_type IN ('expansion_started', 'market_entered')) AS expand, count(*) FILTER (event_type = 'tender_won') AS tender,
  count(*) FILTER (event_type = 'supplier_sought') AS sought, count(*) FILTER (event_type = 'registry_change' AND r <= 2 AND new_location) AS moves, count(*) FILTER (event_type LIKE 'crm_%') AS crm,
  count(*) FILTER (event_type = 'website_changed') AS web, count(*) FILTER (event_type = 'new_hiring' AND regexp_matches(job_title, '(?i)marketing|digital|growth|cmo|web')) AS mkt,
  count(*) FILTER (event_type = 'funding_received') AS fund, count(*) FILTER (event_type IN ('ads_started', 'pixel_installed')) AS ads, count(*) FILTER (event_type IN ('new_director', 'executive_change')) AS exec FROM re GROUP BY entity_id
), lc AS (SELECT source_id AS entity_id, count(*) FILTER (relationship_type = 'located_in') AS places, count(*) FILTER (relationship_type = 'awarded_to') AS awards FROM frel WHERE age_days <= 180 GROUP BY 1
), cc AS (SELECT entity_id, arg_max(value, (-age_days, id)) AS cat FROM fobs WHERE attribute = 'category' GROUP BY 1
), k AS (SELECT fent.id, fent.city, category, cat, rev1, rev2, emp1, emp2, COUNTED
  FROM fent LEFT JOIN oc ON oc.entity_id = fent.id LEFT JOIN ec ON ec.entity_id = fent.id LEFT JOIN lc ON lc.entity_id = fent.id LEFT JOIN cc ON cc.entity_id = fent.id)
""".replace(
    "COUNTED", ", ".join(f"coalesce({c}, 0) AS {c}" for c in "rev_n emp_n tools invests unaudited low pain tech hire expand tender sought moves crm web mkt fund ads exec places awards".split())
)
_GREW = "CASE WHEN {0}2 > 0 AND {0}1 - {0}2 > {0}2 * 0.05::DOUBLE THEN 1 ELSE 0 END"
#: Evidence, score, and confidence (base, step, most) of each signal.
_SIGNAL_SQL = {
    "growth": (f"least(3, hire) + {_GREW.format('rev')} + {_GREW.format('emp')} + expand + CASE WHEN places > 0 THEN 1 ELSE 0 END", "least(45, 25 * least(3, hire)) + CASE WHEN rev_n >= 2 THEN 25 ELSE 0 END + CASE WHEN emp_n >= 2 THEN 25 ELSE 0 END + CASE WHEN expand > 0 OR places > 1 THEN 20 ELSE 0 END", (0.6, 0.08, 0.95)),
    "buying": ("least(3, tender) + least(2, sought) + moves + least(2, awards)", "least(95, 40 * least(3, tender + sought + awards))", (0.65, 0.07, 0.95)),
    "digital_transformation": ("tools + crm + least(2, web) + least(2, mkt)", "20 + 18 * n", (0.65, 0.06, 0.95)),
    "budget": ("least(2, fund) + least(2, ads) + invests", "25 + 25 * n", (0.65, 0.08, 0.95)),
    "urgency": ("unaudited + least(2, exec) + low", "20 + 25 * n", (0.6, 0.08, 0.9)),
    "pain": ("pain", "20 + 16 * n", (0.6, 0.06, 0.9)),
    "intent_fit": ("CASE WHEN contains(lower(city), 'nation_1') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(category || ' ' || coalesce(cat, ''), 'building|legal') THEN 1 ELSE 0 END + tech", "30 + 18 * n", (0.65, 0.07, 0.95)),
}


def signal_sql(kind: str) -> str:
    n, score, (base, step, most) = _SIGNAL_SQL[kind]
    return f"SELECT id, '{kind}' AS type, CAST(least(100, {score}) AS BIGINT) AS score, round(least({most}::DOUBLE, {base}::DOUBLE + n * {step}::DOUBLE), 4) AS confidence, n::BIGINT AS evidence FROM (SELECT *, {n} AS n FROM k) WHERE n > 0"


def found_signals(t: Tables) -> DataFrame:
    counted = K.facts(B.companies(t), B.observations(t), B.events(t), B.relationships(t), HAS, MISSING)
    return K.signals(counted, CITIES, INDUSTRIES)


def _signal_query(kind: str) -> None:
    @query(f"r3_{kind}", COUNTS_SQL + signal_sql(kind))
    def one(t: Tables) -> DataFrame:
        return found_signals(t).where(F.col("type") == kind).withColumn("confidence", F.round("confidence", 4))


for _kind in K.WEIGHTS:
    _signal_query(_kind)

ALL_SQL = COUNTS_SQL + ", s AS (" + " UNION ALL ".join(signal_sql(k) for k in K.WEIGHTS) + "), w AS (SELECT id, score, confidence * CASE type WHEN 'buying' THEN 1.25::DOUBLE WHEN 'digital_transformation' THEN 1.1 WHEN 'urgency' THEN 0.9 WHEN 'pain' THEN 0.85 WHEN 'intent_fit' THEN 1.15 ELSE 1.0 END AS w FROM s)"


@query("r4_signal_strength", ALL_SQL + " SELECT id, CAST(floor(sum(score * w) / sum(w) + 0.5) AS BIGINT) AS strength FROM w GROUP BY id")
def signal_strength(t: Tables) -> DataFrame:
    return K.strength(found_signals(t))


#: Points of feedback actions; the latest row of each entity and action counts.
BOOST_SQL = ", fb AS (SELECT entity_id, sum(CASE a WHEN 0 THEN 10 WHEN 1 THEN -8 ELSE 3 END) AS boost FROM (SELECT DISTINCT entity_id, id % 3 AS a FROM fev) GROUP BY entity_id)"


@query("r6_boosted_score", ALL_SQL + BOOST_SQL + ", r4 AS (SELECT id, floor(sum(score * w) / sum(w) + 0.5) AS strength FROM w GROUP BY id) SELECT id, CAST(greatest(0, least(100, strength + coalesce(boost, 0))) AS BIGINT) AS score FROM r4 LEFT JOIN fb ON entity_id = id")
def boosted(t: Tables) -> DataFrame:
    action = F.when(F.col("id") % 3 == 0, 10).when(F.col("id") % 3 == 1, -8).otherwise(3)
    once = B.events(t).select("entity_id", action.alias("points")).distinct().groupBy("entity_id").agg(F.sum("points").alias("boost"))
    return K.strength(found_signals(t)).join(once, F.col("id") == F.col("entity_id"), "left").select("id", K.boosted(F.col("strength"), F.col("boost")).alias("score"))


@query("a8_facts", """, o AS (SELECT entity_id, count(*) AS observations FROM fobs GROUP BY 1), e AS (SELECT entity_id, count(*) AS events, min(age_days) AS newest_event FROM fev WHERE age_days <= 365 GROUP BY 1), r AS (SELECT source_id, count(*) AS related, max(confidence) AS surest FROM frel GROUP BY 1)
SELECT fent.id, coalesce(observations, 0) AS observations, coalesce(events, 0) AS events, newest_event, coalesce(related, 0) AS related, surest FROM fent LEFT JOIN o ON o.entity_id = id LEFT JOIN e ON e.entity_id = id LEFT JOIN r ON source_id = id""")
def loaded_facts(t: Tables) -> DataFrame:
    """What is loaded for each company: all observations and relationships, events of a year."""
    o = B.observations(t).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("observations"))
    e = B.events(t).where("age_days <= 365").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("events"), F.min("age_days").alias("newest_event"))
    r = B.relationships(t).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("related"), F.max("confidence").alias("surest"))
    return B.companies(t).select("id").join(o, "id", "left").join(e, "id", "left").join(r, "id", "left").fillna(0, ["observations", "events", "related"])


@query("f23_recent_events", "SELECT id FROM fev WHERE age_days <= 180")
def recent_events(t: Tables) -> DataFrame:
    return B.events(t).where(F.col("age_days") <= K.RECENT_DAYS).select("id")


# Ranking and paths


@query("r1_graph_rank", """, e AS (SELECT entity_id, count(*) FILTER (age_days <= 30) AS n, min(age_days) AS age FROM fev GROUP BY 1), r AS (SELECT source_id, count(*) AS n FROM frel GROUP BY 1), o AS (SELECT entity_id, count(*) AS n FROM fobs GROUP BY 1)
SELECT id, CAST(least(100, 35 + CASE WHEN age <= 7 THEN 12 WHEN age <= 30 THEN 8 WHEN age <= 90 THEN 4 ELSE 0 END + CASE WHEN contains(lower(city), 'nation_1') OR contains('nation_1', lower(city)) THEN 10 ELSE 0 END + CASE WHEN contains(category, 'build') OR contains(lower(name), 'build') THEN 8 ELSE 0 END
 + least(20, 4 * coalesce(e.n, 0)) + least(12, 2 * coalesce(r.n, 0)) + least(10, coalesce(o.n, 0) // 2) + floor(5 * 0.7::DOUBLE + 0.5)) AS BIGINT) AS score FROM fent LEFT JOIN e ON e.entity_id = id LEFT JOIN r ON source_id = id LEFT JOIN o ON o.entity_id = id""")
def graph_rank(t: Tables) -> DataFrame:
    """Rank of all companies; events of the last thirty days count."""
    e = B.events(t).groupBy(F.col("entity_id").alias("id")).agg(F.count_if(F.col("age_days") <= 30).alias("events"), F.min("age_days").alias("age"))
    r = B.relationships(t).groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("relationships"))
    o = B.observations(t).groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("observed"))
    rows = B.companies(t).join(e, "id", "left").join(r, "id", "left").join(o, "id", "left").fillna(0, ["events", "relationships", "observed"])
    rows = rows.withColumn("confidence", F.lit(0.7)).withColumn("last_seen_at", F.when(F.col("age").isNotNull(), F.timestamp_seconds(F.lit(10**9) - F.col("age") * 86400)))
    return rows.select("id", graph.rank_score(F.timestamp_seconds(F.lit(10**9)), "nation_1", "build").alias("score"))


PATH_SQL = """, ways AS (SELECT source_id AS near, target_id AS far, relationship_type, confidence, age_days FROM frel UNION ALL SELECT target_id, source_id, relationship_type, confidence, age_days FROM frel),
src AS (SELECT id FROM fent WHERE contains(lower(city), 'nation_1') AND id IN (SELECT entity_id FROM fobs WHERE attribute = 'rating' AND TRY_CAST(value AS DOUBLE) >= 4)),
dst AS (SELECT id FROM fent WHERE category = 'building'),
one AS (SELECT src.id AS origin, far AS node, confidence AS total, least(age_days) AS age, src.id || '>' || far AS path FROM src JOIN ways ON near = src.id WHERE relationship_type = 'competes_with'),
one1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY total DESC, path, age) AS r FROM one) WHERE r = 1),
two AS (SELECT origin, target_id AS node, total + confidence AS total, least(age, age_days) AS age, path || '>' || target_id AS path FROM one1 JOIN frel ON source_id = node WHERE relationship_type = 'hires' AND target_id IN (SELECT id FROM dst)),
best AS (SELECT origin, node, total / 2 AS mean_confidence, age, path FROM (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY total DESC, path, age) AS r FROM two) WHERE r = 1)
"""


def two_hops(t: Tables) -> DataFrame:
    """Companies of a place with a good rating, over competitors in either direction, to builders that these hire for."""
    good = B.observations(t).where("attribute = 'rating'").where(F.col("value").try_cast("double") >= 4).select("entity_id")
    start = B.companies(t).where(C.contains_ci(F.col("city"), "nation_1")).join(good, F.col("id") == F.col("entity_id"), "left_semi")
    builders = B.companies(t).where("category = 'building'").select("id")
    return graph.paths(start, B.relationships(t), [("competes_with", "any", None), ("hires", "out", builders)])


@query("j10_filtered_paths", PATH_SQL + "SELECT origin, node, mean_confidence, path FROM best")
def filtered_paths(t: Tables) -> DataFrame:
    return two_hops(t).select("origin", "node", "mean_confidence", "path")


@query("j10_best_origins", PATH_SQL + "SELECT origin, max(mean_confidence) AS mean_confidence, count(*) AS reached FROM best GROUP BY origin ORDER BY 2 DESC, origin LIMIT 25")
def best_origins(t: Tables) -> DataFrame:
    """With source filters the origins are the result: the best path of each, the best 25 of them."""
    best = two_hops(t).groupBy("origin").agg(F.max("mean_confidence").alias("mean_confidence"), F.count("*").alias("reached"))
    return best.orderBy(F.desc("mean_confidence"), "origin").limit(25)


@query("r2_subgraph_score", PATH_SQL + """SELECT origin, node, CAST(least(100, 35 + 30 + floor(mean_confidence * 20 + 0.5) + CASE WHEN age <= 30 THEN 15 WHEN age <= 90 THEN 8 ELSE 3 END
 + CASE WHEN contains(lower(city), 'nation_2') OR contains('nation_2', lower(city)) THEN 8 ELSE 0 END + CASE WHEN contains(lower(category || ' ' || name), 'building') THEN 7 ELSE 0 END) AS BIGINT) AS score FROM best JOIN fent ON id = node""")
def subgraph_scores(t: Tables) -> DataFrame:
    rows = two_hops(t).join(B.companies(t).withColumnRenamed("id", "node"), "node")
    score = K.subgraph_score(F.col("hops"), F.col("mean_confidence"), F.col("age_days"), F.col("city"), F.concat_ws(" ", "category", "name"), ("nation_2",), ("building",))
    return rows.select("origin", "node", score.alias("score"))


# Projections


def latest_values(t: Tables, names: list[str]) -> DataFrame:
    """One row for each entity, one column for each attribute: its newest value."""
    rows = B.observations(t).where(F.col("attribute").isin(names))
    newest = F.struct(-F.col("age_days"), "id")
    return rows.groupBy(F.col("entity_id").alias("id")).agg(*(F.max_by(F.when(F.col("attribute") == n, F.col("value")), F.when(F.col("attribute") == n, newest)).alias(n) for n in names))


def latest_sql(names: list[str]) -> str:
    return "SELECT entity_id, " + ", ".join(f"arg_max(value, (-age_days, id)) FILTER (attribute = '{n}') AS {n}" for n in names) + " FROM fobs GROUP BY entity_id"


_SHOWN = ["category", "phone", "email", "meta_pixel", "google_tag_manager", "ssl", "rating", "employees", "revenue"]


@query("p31_lead_projection", f", l AS ({latest_sql(_SHOWN)}) SELECT fent.id AS entity_id, name AS azienda, city AS citta, coalesce(l.category, fent.category) AS categoria, phone AS telefono, email, NULL::VARCHAR AS pec_email, NULL::VARCHAR AS mobile_phone, meta_pixel, google_tag_manager, ssl, rating, employees AS dipendenti, revenue AS fatturato FROM fent LEFT JOIN l ON entity_id = fent.id")
def lead_projection(t: Tables) -> DataFrame:
    """Entities as lead rows: newest values of shown attributes; certified mail and mobile numbers are never shown."""
    none = F.lit(None).cast("string")
    rows = B.companies(t).withColumnRenamed("category", "own").join(latest_values(t, _SHOWN), "id", "left")
    return rows.select(F.col("id").alias("entity_id"), F.col("name").alias("azienda"), F.col("city").alias("citta"), F.coalesce("category", "own").alias("categoria"), F.col("phone").alias("telefono"), "email", none.alias("pec_email"), none.alias("mobile_phone"), "meta_pixel", "google_tag_manager", "ssl", "rating", F.col("employees").alias("dipendenti"), F.col("revenue").alias("fatturato"))


@query("p32_contact_projection", f", l AS ({latest_sql(['phone', 'email'])}) SELECT id AS entity_id, phone, email FROM fent LEFT JOIN l ON entity_id = id")
def contact_projection(t: Tables) -> DataFrame:
    return B.companies(t).select("id").join(latest_values(t, ["phone", "email"]), "id", "left").withColumnRenamed("id", "entity_id")


@query("p32_access_quota", "SELECT event_id, 'u' || (user_id % 5) AS user_id, n, n <= 200 AS allowed, greatest(0, 200 - n) AS remaining FROM (SELECT *, count(*) OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM events)")
def access_quota(t: Tables) -> DataFrame:
    """Accesses of the last 24 hours at each access, and whether it is still within two hundred."""
    at = t.raw("events").select("event_id", (F.col("user_id") % 5).alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return A.counted_back(at, "u", "at", 86_400_000_000).select("event_id", F.concat(F.lit("u"), F.col("u")).alias("user_id"), "n", (F.col("n") <= 200).alias("allowed"), F.greatest(F.lit(0), 200 - F.col("n")).alias("remaining"))


ALIAS_SQL = ", al AS (SELECT 's:' || s_suppkey AS entity_id, 'domain' AS alias_type, 'shop' || (s_suppkey % 40) || '.it' AS alias_value, (s_suppkey % 7) / 7.0::DOUBLE AS confidence, s_suppkey AS created FROM supplier), en AS (SELECT 's:' || s_suppkey AS id, CASE WHEN s_suppkey % 10 = 7 THEN 's:' || (s_suppkey + 1) END AS merged_into_id FROM supplier)"


@query("j6_resolve_alias", ALIAS_SQL + " SELECT alias_type, alias_value, arg_max(entity_id, (confidence, created)) AS entity_id FROM al JOIN en ON en.id = entity_id WHERE merged_into_id IS NULL GROUP BY 1, 2")
def resolve_alias(t: Tables) -> DataFrame:
    """The entity of each alias: unmerged, the surest, then the newest."""
    s = F.col("s_suppkey")
    rows = t.raw("supplier").select(F.concat(F.lit("s:"), s).alias("entity_id"), F.lit("domain").alias("alias_type"), F.concat(F.lit("shop"), s % 40, F.lit(".it")).alias("alias_value"), (s % 7 / F.lit(7.0)).alias("confidence"), s.alias("created"))
    merged = F.when(s % 10 == 7, F.concat(F.lit("s:"), s + 1))
    entities = t.raw("supplier").select(F.concat(F.lit("s:"), s).alias("id"), merged.alias("merged_into_id"))
    return graph.resolve_aliases(rows, entities)


# Summaries


@query("a6_learning_metrics", "SELECT count(DISTINCT entity_id) FILTER (id % 3 = 0) AS positive, count(DISTINCT entity_id) FILTER (id % 3 = 1) AS negative, count(DISTINCT event_type) AS actions FROM fev")
def learning_metrics(t: Tables) -> DataFrame:
    e = B.events(t)
    return e.agg(F.count_distinct(F.when(F.col("id") % 3 == 0, F.col("entity_id"))).alias("positive"), F.count_distinct(F.when(F.col("id") % 3 == 1, F.col("entity_id"))).alias("negative"), F.count_distinct("event_type").alias("actions"))


def _top(df: DataFrame, by: str, k: int) -> DataFrame:
    """The k most frequent values as one list of ``value=count``; ties go by value."""
    best = df.groupBy(F.col(by).alias("v")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").limit(k)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "v")))
    return best.agg(F.array_join(F.transform(listed, lambda x: F.concat(x["v"], F.lit("="), (-x["minus"]).cast("string"))), ",").alias(f"top_{by}"))


def _top_sql(frame: str, by: str, k: int) -> str:
    return f"(SELECT coalesce(string_agg(v || '=' || n, ',' ORDER BY n DESC, v), '') FROM (SELECT {by} AS v, count(*) AS n FROM {frame} GROUP BY 1 ORDER BY n DESC, v LIMIT {k}))"


@query("a1_graph_summary", f"SELECT (SELECT count(*) FROM fent) AS companies, (SELECT count(*) FROM fobs) AS observations, (SELECT count(*) FROM frel) AS relationships, (SELECT count(*) FROM fev) AS events, (SELECT count(*) FROM fev WHERE NOT processed) AS unprocessed, (SELECT count(*) FROM fev WHERE age_days <= 7) AS last_week, {_top_sql('fev WHERE age_days <= 30', 'event_type', 20)} AS top_event_type, {_top_sql('fent', 'city', 10)} AS top_city, {_top_sql('fobs WHERE age_days <= 30', 'source', 15)} AS top_source")
def graph_summary(t: Tables) -> DataFrame:
    """All measures of the graph in one row."""
    e, o = B.events(t), B.observations(t)
    parts = [
        B.companies(t).agg(F.count("*").alias("companies")),
        o.agg(F.count("*").alias("observations")),
        B.relationships(t).agg(F.count("*").alias("relationships")),
        e.agg(F.count("*").alias("events"), F.count_if(~F.col("processed")).alias("unprocessed"), F.count_if(F.col("age_days") <= 7).alias("last_week")),
        _top(e.where("age_days <= 30"), "event_type", 20),
        _top(B.companies(t), "city", 10),
        _top(o.where("age_days <= 30"), "source", 15),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return out


@query("a26_market_map", ", p AS (SELECT id, city, category, CASE WHEN balance < 0 THEN 'competitor' ELSE 'lead' END AS kind FROM fent) SELECT count(*) AS total, count(*) FILTER (kind = 'competitor') AS competitors, count(*) FILTER (kind = 'lead') AS leads, list_sort(list(DISTINCT category)) AS categories, list_sort(list(DISTINCT city)) AS cities FROM p")
def market_map(t: Tables) -> DataFrame:
    kind = F.when(F.col("balance") < 0, "competitor").otherwise("lead")
    return B.companies(t).agg(F.count("*").alias("total"), F.count_if(kind == "competitor").alias("competitors"), F.count_if(kind == "lead").alias("leads"), F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("city")).alias("cities"))


# Alerts and events

_ALERTS = ["new_hiring", "tender_won", "funding_received", "website_changed", "registry_change", "crm_installed", "pixel_removed", "revenue_changed", "employees_changed"]


@query("e15_alert_dispatch", f"SELECT id, entity_id, event_type FROM fev WHERE NOT processed AND event_type IN ({', '.join(repr(x) for x in _ALERTS)})")
def alert_dispatch(t: Tables) -> DataFrame:
    """Unprocessed events of the nine types that alert."""
    return B.events(t).where(~F.col("processed") & F.col("event_type").isin(_ALERTS)).select("id", "entity_id", "event_type")


@query("t7_event_batch", "SELECT id, event_type FROM fev WHERE NOT processed ORDER BY age_days DESC, id LIMIT 100")
def event_batch(t: Tables) -> DataFrame:
    """The hundred unprocessed events that wait longest."""
    return B.events(t).where(~F.col("processed")).orderBy(F.desc("age_days"), "id").limit(100).select("id", "event_type")


@query("f16_headlines", "SELECT id, CASE WHEN new_location THEN left('summary of ' || event_type || ' at ' || entity_id, 160) WHEN event_type = 'new_hiring' THEN job_title WHEN event_type = 'website_changed' THEN 'Sito: ' || entity_id || '.it' ELSE '' END AS headline FROM fev")
def headlines(t: Tables) -> DataFrame:
    summary = F.when(F.col("new_location"), F.concat(F.lit("summary of "), "event_type", F.lit(" at "), "entity_id"))
    return B.events(t).select("id", C.headline(summary, F.when(F.col("event_type") == "new_hiring", F.col("job_title")), F.when(F.col("event_type") == "website_changed", F.concat("entity_id", F.lit(".it")))).alias("headline"))
