"""Queries of the library's own operators over whole tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakegraph.functions import columns as C
from lakegraph.functions import text as X
from lakegraph.operators import asof, graph
from lakegraph.plans.query import Event, Observation, Query, Relationship, execute, having_observation
from lakegraph.sources.sinks import stored
from lakegraph.sources.tables import BINDING_SQL, Tables

AS_OF = "2001-08-02"
EVENTS_AS_OF = "2024-01-31"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, bound: bool = True):
    def put(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            _SQL[name] = (BINDING_SQL if bound else "") + sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


# Scans, predicates and structured queries


@query("s2_entity_list", "SELECT id, name, city, last_seen_at FROM ent WHERE merged_into_id IS NULL AND entity_type = 'company' AND city = 'NATION_6' AND contains(lower(name), 'customer') ORDER BY last_seen_at DESC NULLS FIRST, id LIMIT 50 OFFSET 5")
def entity_list(t: Tables) -> DataFrame:
    e = t.entities().where("merged_into_id is null and entity_type = 'company' and city = 'NATION_6'").where(C.contains_ci(F.col("name"), "customer"))
    return e.orderBy(F.col("last_seen_at").desc_nulls_first(), "id").offset(5).limit(50).select("id", "name", "city", "last_seen_at")


@query("s3_event_scan", "SELECT id, entity_id, occurred_at FROM ev WHERE event_type = 'purchase' AND NOT processed ORDER BY occurred_at DESC, id LIMIT 100")
def event_scan(t: Tables) -> DataFrame:
    return t.events().where("event_type = 'purchase' and not processed").orderBy(F.desc("occurred_at"), "id").limit(100).select("id", "entity_id", "occurred_at")


@query("s5_json_source", "SELECT id, CAST(json_extract(payload, '$.k') AS BIGINT) AS k FROM ev WHERE payload IS NOT NULL")
def json_source(t: Tables) -> DataFrame:
    return t.events().where("payload is not null").select("id", F.from_json("payload", "k long").k.alias("k"))


@query("s7_lookup", "SELECT id, name FROM ent WHERE id = 'c:7'")
def lookup(t: Tables) -> DataFrame:
    return t.entities().where("id = 'c:7'").limit(1).select("id", "name")


@query("s8_count_scan", "SELECT (SELECT count(*) FROM ent) AS entities, (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM rel) AS relationships, (SELECT count(*) FROM ev) AS events")
def count_scan(t: Tables) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for w, df in (("entities", t.entities()), ("observations", t.observations()), ("relationships", t.relationships()), ("events", t.events()))]
    both = counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])
    return both.agg(*(F.max(F.when(F.col("what") == w, F.col("n"))).alias(w) for w in ("entities", "observations", "relationships", "events")))


@query("s9_upsert_keep_last", "SELECT dedup_key, id, value FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY occurred_at DESC, id DESC) AS n FROM (SELECT *, entity_id || ':' || event_type || ':' || strftime(occurred_at, '%Y-%m-%d') AS dedup_key FROM ev)) WHERE n = 1")
def upsert(t: Tables) -> DataFrame:
    keyed = t.events().withColumn("dedup_key", C.day_key(F.col("entity_id"), F.col("event_type"), at=F.col("occurred_at")))
    last = keyed.groupBy("dedup_key").agg(F.max_by(F.struct("id", "value"), F.struct("occurred_at", "id")).alias("r"))
    return last.select("dedup_key", "r.id", "r.value")


@query("s10_insert_ignore", "SELECT DISTINCT entity_id FROM ev WHERE event_type = 'error' AND entity_id NOT IN (SELECT entity_id FROM ev WHERE event_type = 'signup')")
def insert_ignore(t: Tables) -> DataFrame:
    have = t.events().where("event_type = 'signup'").select("entity_id")
    return t.events().where("event_type = 'error'").select("entity_id").distinct().join(have, "entity_id", "left_anti")


_PREDICATES = {
    "p1_eq": (Observation("status", "eq", "P"), "attribute = 'status' AND value_text = 'P'"),
    "p2_neq": (Observation("status", "neq", "F"), "attribute = 'status' AND value_text <> 'F'"),
    "p3_gt": (Observation("revenue", "gt", 400000), "attribute = 'revenue' AND value_num > 400000"),
    "p4_gte": (Observation("revenue", "gte", 400000), "attribute = 'revenue' AND value_num >= 400000"),
    "p5_lt": (Observation("revenue", "lt", 1200), "attribute = 'revenue' AND value_num < 1200"),
    "p6_lte": (Observation("revenue", "lte", 1200), "attribute = 'revenue' AND value_num <= 1200"),
    "p7_in": (Observation("status", "in", ("P", "O")), "attribute = 'status' AND value_text IN ('P', 'O')"),
    "p8_contains": (Observation("status", "contains", "p"), "attribute = 'status' AND contains(lower(value_text), 'p')"),
    "p9_is_null": (Observation("status", "is_null"), "attribute = 'status' AND value_text IS NULL AND value_num IS NULL"),
    "p10_not_null": (Observation("revenue", "not_null"), "attribute = 'revenue'"),
}
for _name, (_p, _where) in _PREDICATES.items():
    query(_name, f"SELECT id FROM ent WHERE id IN (SELECT entity_id FROM obs WHERE {_where})")(lambda t, p=_p: having_observation(t.entities(), t.observations(), p).select("id"))


@query("p1_eq_latest", "SELECT id FROM ent WHERE id IN (SELECT entity_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY observed_at DESC, id DESC) AS n FROM obs WHERE attribute = 'status') WHERE n = 1 AND value_text = 'P')")
def eq_latest(t: Tables) -> DataFrame:
    return having_observation(t.entities(), t.observations(), Observation("status", "eq", "P"), latest_only=True).select("id")


FLAGSHIP = Query("company", observations=(Observation("revenue", "gt", 150000),), relationships=(Relationship("located_in", target_type="location", target_name="a"),), limit=200)


@query("j1_structured_query", "SELECT id, name, last_seen_at FROM ent WHERE entity_type = 'company' AND id IN (SELECT entity_id FROM obs WHERE attribute = 'revenue' AND value_num > 150000) AND id IN (SELECT source_id FROM rel JOIN ent t ON t.id = target_id WHERE relationship_type = 'located_in' AND t.entity_type = 'location' AND contains(lower(t.name), 'a')) ORDER BY last_seen_at DESC NULLS FIRST, id LIMIT 200")
def structured(t: Tables) -> DataFrame:
    return execute(FLAGSHIP, t.entities(), t.observations(), t.relationships(), t.events()).select("id", "name", "last_seen_at")


@query("j2_incoming_relationship", "SELECT id FROM ent WHERE entity_type = 'company' AND id IN (SELECT target_id FROM rel WHERE relationship_type = 'sells_to' AND source_id IN (SELECT id FROM ent WHERE city = 'NATION_6'))")
def incoming(t: Tables) -> DataFrame:
    near = t.relationships().where("relationship_type = 'sells_to'").join(t.entities().where("city = 'NATION_6'").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return t.entities().where("entity_type = 'company'").join(near.select(F.col("target_id").alias("id")), "id", "left_semi").select("id")


@query("j3_event_window", "SELECT id FROM ent WHERE entity_type = 'company' AND id IN (SELECT entity_id FROM ev WHERE event_type = 'purchase' AND occurred_at >= TIMESTAMP '2024-01-10' AND occurred_at < TIMESTAMP '2024-01-12')")
def event_window(t: Tables) -> DataFrame:
    q = Query("company", events=(Event("purchase", "2024-01-10", "2024-01-12"),), limit=None)
    return execute(q, t.entities(), t.observations(), t.relationships(), t.events()).select("id")


@query("j5_related_entities", "SELECT source_id, target_id, name, rel.confidence AS confidence, observed_at FROM rel JOIN ent ON id = target_id WHERE relationship_type = 'sells_to'")
def related(t: Tables) -> DataFrame:
    names = t.entities().select(F.col("id").alias("target_id"), "name")
    return t.relationships().where("relationship_type = 'sells_to'").join(names, "target_id").select("source_id", "target_id", "name", "confidence", "observed_at")


@query("j7_anti_signal", "SELECT id FROM ent WHERE entity_type = 'company' AND NOT EXISTS (SELECT 1 FROM ev WHERE entity_id = ent.id AND event_type = 'error')")
def anti(t: Tables) -> DataFrame:
    return t.entities().where("entity_type = 'company'").join(t.events().where("event_type = 'error'").select(F.col("entity_id").alias("id")), "id", "left_anti").select("id")


@query("j9_collect_distinct", "SELECT id, coalesce(string_agg(event_type, ',' ORDER BY event_type), '') AS kinds FROM ent LEFT JOIN (SELECT DISTINCT entity_id, event_type FROM ev) ON entity_id = id WHERE entity_type = 'company' GROUP BY id")
def collect_distinct(t: Tables) -> DataFrame:
    kinds = t.events().groupBy(F.col("entity_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))
    return t.entities().where("entity_type = 'company'").select("id").join(kinds, "id", "left").select("id", F.coalesce("kinds", F.lit("")).alias("kinds"))


@query("j10_two_hop_paths", """, two AS (SELECT a.source_id AS origin, b.target_id AS node, (a.confidence + b.confidence) / 2 AS mean_confidence, a.source_id || '>' || a.target_id || '>' || b.target_id AS path FROM rel a JOIN rel b ON a.target_id = b.source_id WHERE a.relationship_type = 'sells_to' AND b.relationship_type = 'located_in')
SELECT origin, node, mean_confidence, path FROM (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY mean_confidence DESC, path) AS n FROM two) WHERE n = 1""")
def two_hop(t: Tables) -> DataFrame:
    start = t.entities().where("category = 'SUPPLIER'")
    return graph.best_paths(start, t.relationships(), [("sells_to", "out"), ("located_in", "out")]).select("origin", "node", "mean_confidence", "path")


@query("j11_subgraph", ", star AS (SELECT source_id, target_id FROM rel WHERE source_id = 's:3' OR target_id = 's:3'), nodes AS (SELECT source_id AS id FROM star UNION SELECT target_id FROM star) SELECT source_id, target_id, relationship_type FROM rel WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)")
def star(t: Tables) -> DataFrame:
    return graph.subgraph(t.entities().where("id = 's:3'"), t.relationships()).select("source_id", "target_id", "relationship_type")


@query("j12_city_graph", ", nodes AS (SELECT id FROM ent WHERE city = 'NATION_6') SELECT source_id, target_id, relationship_type FROM rel WHERE source_id IN (SELECT id FROM nodes) AND target_id IN (SELECT id FROM nodes)")
def city_graph(t: Tables) -> DataFrame:
    nodes = t.entities().where("city = 'NATION_6'").select("id")
    e = t.relationships()
    return e.join(nodes, e.source_id == nodes.id, "left_semi").join(nodes, F.col("target_id") == F.col("id"), "left_semi").select("source_id", "target_id", "relationship_type")


@query("j13_as_of", "SELECT entity_id, attribute, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute ORDER BY observed_at DESC, id DESC) AS n FROM obs WHERE observed_at <= TIMESTAMP '1998-01-01') WHERE n = 1")
def observed_as_of(t: Tables) -> DataFrame:
    past = t.observations().where("observed_at <= timestamp '1998-01-01'")
    return past.groupBy("entity_id", "attribute").agg(F.max_by("id", F.struct("observed_at", "id")).alias("id"))


@query("j13_as_of_many", "SELECT o1.id AS probe, max_by(o2.id, (o2.observed_at, o2.id)) AS id FROM obs o1 JOIN obs o2 ON o1.entity_id = o2.entity_id AND o2.attribute = 'revenue' AND o1.attribute = 'status' AND o2.observed_at <= o1.observed_at GROUP BY o1.id")
def as_of_many(t: Tables) -> DataFrame:
    """Many probes at once: both sides sorted together by entity and time, the last value is carried forward."""
    o = t.observations().select(F.col("entity_id").alias("key"), F.col("observed_at").alias("at"), "attribute", "id")
    probes = o.where("attribute = 'status'").select("key", "at", F.col("id").alias("probe"))
    facts = o.where("attribute = 'revenue'").select("key", "at", "id", F.col("id").alias("value"))
    found = asof.as_of_many(probes, facts, ["value"])
    return found.where("value is not null").select("probe", F.col("value").alias("id"))


@query("j19_drift", "SELECT host FROM (SELECT DISTINCT regexp_extract(url, '://(?:www\\.)?([^/?#]*)', 1) AS host FROM pages) WHERE host NOT IN (SELECT lower(name) FROM ent)")
def drift(t: Tables) -> DataFrame:
    hosts = t.raw("pages").select(C.normalize_domain(F.col("url")).alias("host")).distinct()
    return hosts.join(t.entities().select(F.lower("name").alias("host")), "host", "left_anti")


@query("j21_merge_chain", "SELECT id, CASE WHEN id LIKE 's:%7' THEN 's:' || (CAST(substr(id, 3) AS BIGINT) + 2) WHEN id LIKE 's:%8' THEN 's:' || (CAST(substr(id, 3) AS BIGINT) + 1) ELSE id END AS final_id FROM ent")
def merge_chain(t: Tables) -> DataFrame:
    return graph.resolve_merges(t.entities())


# Aggregations


@query("a1_event_types", "SELECT event_type, count(*) AS n, count(*) FILTER (NOT processed) AS unprocessed FROM ev WHERE occurred_at >= TIMESTAMP '2024-01-24' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 20")
def event_types(t: Tables) -> DataFrame:
    recent = t.events().where(F.col("occurred_at") >= F.lit(EVENTS_AS_OF).cast("timestamp") - F.expr("interval 7 days"))
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(~F.col("processed")).alias("unprocessed")).orderBy(F.desc("n"), "event_type").limit(20)


@query("a1_top_cities", "SELECT city, count(*) AS n FROM ent WHERE entity_type = 'company' AND merged_into_id IS NULL AND coalesce(city, '') <> '' GROUP BY city ORDER BY n DESC, city LIMIT 10")
def top_cities(t: Tables) -> DataFrame:
    e = t.entities().where("entity_type = 'company' and merged_into_id is null and coalesce(city, '') <> ''")
    return e.groupBy("city").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "city").limit(10)


@query("a1_top_sources", "SELECT source, count(*) AS n FROM obs GROUP BY source ORDER BY n DESC, source LIMIT 15")
def top_sources(t: Tables) -> DataFrame:
    return t.observations().groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(15)


@query("a3_distribution", "SELECT coalesce(category, 'unknown') AS category, count(*) AS n FROM ent GROUP BY 1")
def distribution(t: Tables) -> DataFrame:
    return t.entities().groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("a4_freshness", ", ages AS (SELECT date_diff('day', last_seen_at::DATE, DATE '2001-08-02') AS age FROM ent WHERE last_seen_at IS NOT NULL) SELECT CAST(floor(avg(age) + 0.5) AS BIGINT) AS mean_age, CAST((SELECT age FROM (SELECT age, row_number() OVER (ORDER BY age) - 1 AS r FROM ages) WHERE r = (SELECT count(*) // 2 FROM ages)) AS BIGINT) AS upper_median, count(*) FILTER (age > 90) AS stale FROM ages")
def freshness(t: Tables) -> DataFrame:
    """The upper median comes from a histogram of whole days, so that no group gathers all rows."""
    ages = t.entities().where("last_seen_at is not null").select(F.datediff(F.lit(AS_OF).cast("date"), F.to_date("last_seen_at")).cast("long").alias("age"))
    days = ages.groupBy("age").agg(F.count("*").alias("n"))
    upto = days.withColumn("upto", F.sum("n").over(Window.orderBy("age"))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return upto.agg(C.half_up(F.sum(F.col("age") * F.col("n")) / F.sum("n")).cast("long").alias("mean_age"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("age"))).alias("upper_median"), F.coalesce(F.sum(F.when(F.col("age") > 90, F.col("n"))), F.lit(0)).cast("long").alias("stale"))


@query("a7_entity_counts", "SELECT id, (SELECT count(*) FROM ev WHERE entity_id = ent.id) AS events, (SELECT count(*) FROM rel WHERE source_id = ent.id) AS relationships, (SELECT count(*) FROM obs WHERE entity_id = ent.id) AS observed FROM ent")
def entity_counts(t: Tables) -> DataFrame:
    return graph.with_counts(t.entities(), t.events(), t.relationships(), t.observations()).select("id", "events", "relationships", "observed")


_KPI_SQL = "SELECT count(*) AS total, count(*) FILTER (stage = 'won') AS won, count(*) FILTER (stage = 'lost') AS lost, count(*) FILTER (stage = 'active') AS active, count(*) FILTER (stage = 'active' AND updated_at < TIMESTAMP '2001-07-26') AS stagnant, round(sum(deal_value) FILTER (stage = 'active'), 2) AS pipeline_value, round(sum(deal_value) FILTER (stage = 'won'), 2) AS revenue, CAST(floor(avg(score) FILTER (score > 0) + 0.5) AS BIGINT) AS mean_score, CAST(floor(100.0 * count(*) FILTER (stage = 'won') / count(*) FILTER (stage IN ('won', 'lost')) + 0.5) AS BIGINT) AS win_rate FROM deals"


@query("a9_pipeline_kpis", _KPI_SQL)
def kpis(t: Tables) -> DataFrame:
    is_ = lambda s: F.col("stage") == s
    return t.deals().agg(F.count("*").alias("total"), F.count_if(is_("won")).alias("won"), F.count_if(is_("lost")).alias("lost"), F.count_if(is_("active")).alias("active"), F.count_if(is_("active") & (C.days_between(as_of(), F.col("updated_at")) > 7)).alias("stagnant"), F.round(F.sum(F.when(is_("active"), F.col("deal_value"))), 2).alias("pipeline_value"), F.round(F.sum(F.when(is_("won"), F.col("deal_value"))), 2).alias("revenue"), C.half_up(F.avg(F.when(F.col("score") > 0, F.col("score")))).cast("long").alias("mean_score"), C.half_up(100.0 * F.count_if(is_("won")) / F.count_if(F.col("stage").isin("won", "lost"))).cast("long").alias("win_rate"))


@query("a11_closure_lift", """, closed AS (SELECT *, stage = 'won' AS w FROM deals WHERE stage IN ('won', 'lost')), base AS (SELECT floor(100.0 * count(*) FILTER (w) / count(*) + 0.5) AS b, count(*) AS n FROM closed),
seg AS (SELECT unnest(list_filter([CASE WHEN score >= 70 THEN 'score_hot' END, CASE WHEN score >= 50 AND score < 70 THEN 'score_warm' END, CASE WHEN deal_value > 200000 THEN 'large' END], lambda x: x IS NOT NULL)) AS signal, w FROM closed),
s AS (SELECT signal, count(*) FILTER (w) AS won, count(*) FILTER (NOT w) AS lost FROM seg GROUP BY signal HAVING count(*) >= 2)
SELECT signal, won, lost, CAST(floor(100.0 * won / (won + lost) + 0.5) - b AS BIGINT) AS lift, least(0.95::DOUBLE, round(0.45 + (won + lost) * 0.08, 2)::DOUBLE) AS confidence FROM s, base WHERE n >= 3 ORDER BY lift DESC, signal LIMIT 8""")
def closure_lift(t: Tables) -> DataFrame:
    closed = t.deals().where("stage in ('won', 'lost')").withColumn("w", F.col("stage") == "won")
    flags = {"score_hot": F.col("score") >= 70, "score_warm": (F.col("score") >= 50) & (F.col("score") < 70), "large": F.col("deal_value") > 200000, "all": F.lit(True)}
    rows = closed.select("w", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(s)) for s, c in flags.items())))).alias("signal"))
    groups = rows.groupBy("signal").agg(F.count_if("w").alias("won"), F.count_if(~F.col("w")).alias("lost"))
    rate = C.half_up(100.0 * F.col("won") / (F.col("won") + F.col("lost")))
    base = groups.where("signal = 'all' and won + lost >= 3").select(rate.alias("b"))
    return groups.where("signal <> 'all' and won + lost >= 2").join(F.broadcast(base)).select("signal", "won", "lost", (rate - F.col("b")).cast("long").alias("lift"), F.least(F.lit(0.95), F.round(0.45 + (F.col("won") + F.col("lost")) * 0.08, 2)).alias("confidence")).orderBy(F.desc("lift"), "signal").limit(8)


@query("a12_mesh", "SELECT category, count(*) AS n, round(avg(score), 4) AS mean_score, CAST(floor(100.0 * count(*) FILTER (deal_value < 50000) / count(*) + 0.5) AS BIGINT) AS small_pct FROM deals GROUP BY category ORDER BY n DESC, category LIMIT 8")
def mesh(t: Tables) -> DataFrame:
    return t.deals().groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), C.half_up(100.0 * F.count_if(F.col("deal_value") < 50000) / F.count("*")).cast("long").alias("small_pct")).orderBy(F.desc("n"), "category").limit(8)


@query("a14_segment_stats", "SELECT city, count(*) AS leads, round(avg(score), 4) AS mean_score, count(DISTINCT lead) AS companies FROM deals GROUP BY city")
def segment_stats(t: Tables) -> DataFrame:
    return t.deals().groupBy("city").agg(F.count("*").alias("leads"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_distinct("lead").alias("companies"))


@query("a16_hot_list", "SELECT id, score, deal_value FROM deals WHERE stage = 'active' ORDER BY score DESC, deal_value DESC, id LIMIT 20")
def hot_list(t: Tables) -> DataFrame:
    return t.deals().where("stage = 'active'").orderBy(F.desc("score"), F.desc("deal_value"), "id").limit(20).select("id", "score", "deal_value")


@query("a16_best_city", ", c AS (SELECT city, floor(100.0 * count(*) FILTER (stage = 'won') / count(*) FILTER (stage IN ('won', 'lost')) + 0.5) AS win_rate, round(sum(deal_value) FILTER (stage = 'won'), 2) AS revenue FROM deals GROUP BY city HAVING count(*) FILTER (stage IN ('won', 'lost')) > 0) SELECT city, CAST(win_rate AS BIGINT) AS win_rate, revenue FROM c ORDER BY win_rate DESC, revenue DESC, city LIMIT 1")
def best_city(t: Tables) -> DataFrame:
    closed = F.count_if(F.col("stage").isin("won", "lost"))
    g = t.deals().groupBy("city").agg(closed.alias("closed"), F.count_if(F.col("stage") == "won").alias("won"), F.round(F.sum(F.when(F.col("stage") == "won", F.col("deal_value"))), 2).alias("revenue")).where("closed > 0")
    return g.select("city", C.half_up(100.0 * F.col("won") / F.col("closed")).cast("long").alias("win_rate"), "revenue").orderBy(F.desc("win_rate"), F.desc("revenue"), "city").limit(1)


@query("a17_composite_index", f", k AS ({_KPI_SQL}), x AS (SELECT floor(win_rate * 0.55 + 0.5) AS conversion, floor(least(100, greatest(0, 100 - 100.0 * stagnant / active * 1.2 + least(20, active * 2))) + 0.5) AS velocity FROM k) SELECT CAST(conversion AS BIGINT) AS conversion, CAST(velocity AS BIGINT) AS velocity, CASE WHEN conversion * 0.3 + velocity * 0.25 >= 40 THEN 'D' ELSE 'F' END AS grade FROM x")
def composite(t: Tables) -> DataFrame:
    k = kpis(t)
    x = k.select(C.clamp(F.col("win_rate") * 0.55).cast("long").alias("conversion"), C.clamp(F.lit(100) - 100.0 * F.col("stagnant") / F.col("active") * 1.2 + F.least(F.lit(20), F.col("active") * 2)).cast("long").alias("velocity"))
    return x.select("conversion", "velocity", C.grade(F.col("conversion") * 0.3 + F.col("velocity") * 0.25).alias("grade"))


_WEIGHTS = {"purchase": 10, "click": 2, "view": 1, "signup": 5, "error": -8}


@query("a20_feedback_boost", "SELECT entity_id, sum(CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'signup' THEN 5 ELSE -8 END)::BIGINT AS boost FROM (SELECT DISTINCT entity_id, event_type FROM ev) GROUP BY entity_id")
def feedback_boost(t: Tables) -> DataFrame:
    """The latest row of each entity and action counts once."""
    latest = t.events().groupBy("entity_id", "event_type").agg(F.max_by("id", F.struct("occurred_at", "id")).alias("id"))
    weight = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in _WEIGHTS.items()))
    return latest.groupBy("entity_id").agg(F.sum(weight).cast("long").alias("boost"))


@query("a22_shared_contacts", "SELECT page_id, CASE WHEN count(*) OVER (PARTITION BY host) < 3 THEN host END AS host FROM (SELECT page_id, regexp_extract(url, '://(?:www\\.)?([^/?#]*)', 1) AS host FROM pages)")
def shared_contacts(t: Tables) -> DataFrame:
    p = t.raw("pages").select("page_id", C.normalize_domain(F.col("url")).alias("host"))
    many = p.groupBy("host").agg(F.count("*").alias("n")).where("n >= 3").select("host", F.lit(True).alias("shared"))
    return p.join(many, "host", "left").select("page_id", F.when(F.col("shared").isNull(), F.col("host")).alias("host"))


@query("a28_batch_counters", "SELECT event_type, count(*) FILTER (processed) AS done, count(*) FILTER (NOT processed) AS failed FROM ev GROUP BY event_type")
def batch_counters(t: Tables) -> DataFrame:
    return t.events().groupBy("event_type").agg(F.count_if("processed").alias("done"), F.count_if(~F.col("processed")).alias("failed"))


# Windows


@query("w1_latest", "SELECT entity_id, attribute, id FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, attribute ORDER BY observed_at DESC, id DESC) AS n FROM obs) WHERE n = 1")
def latest(t: Tables) -> DataFrame:
    return graph.latest(t.observations()).select("entity_id", "attribute", "id")


@query("w2_timeline", "SELECT id, observed_at FROM obs WHERE entity_id = 'c:7' ORDER BY observed_at DESC, id LIMIT 200")
def timeline(t: Tables) -> DataFrame:
    return t.observations().where("entity_id = 'c:7'").orderBy(F.desc("observed_at"), "id").limit(200).select("id", "observed_at")


@query("w3_first_seen", "SELECT entity_id, attribute, min(observed_at) AS first_seen FROM obs GROUP BY entity_id, attribute")
def first_seen(t: Tables) -> DataFrame:
    return t.observations().groupBy("entity_id", "attribute").agg(F.min("observed_at").alias("first_seen"))


@query("w4_growth", "SELECT id, value_num > before * 1.05 AS grew FROM (SELECT id, value_num, lag(value_num) OVER (PARTITION BY entity_id ORDER BY observed_at, id) AS before FROM obs WHERE attribute = 'revenue') WHERE before IS NOT NULL")
def growth(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("observed_at", "id")
    o = t.observations().where("attribute = 'revenue'").withColumn("before", F.lag("value_num").over(w))
    return o.where("before is not null").select("id", (F.col("value_num") > F.col("before") * 1.05).alias("grew"))


@query("w5_year_over_year", ", y AS (SELECT entity_id, year(observed_at) AS y, sum(value_num) AS v FROM obs WHERE attribute = 'revenue' GROUP BY 1, 2) SELECT a.entity_id, a.y::BIGINT AS y, a.v >= b.v * 1.2 AS grew FROM y a JOIN y b ON a.entity_id = b.entity_id AND a.y = b.y + 1")
def year_over_year(t: Tables) -> DataFrame:
    y = t.observations().where("attribute = 'revenue'").groupBy("entity_id", F.year("observed_at").cast("long").alias("y")).agg(F.sum("value_num").alias("v"))
    w = Window.partitionBy("entity_id").orderBy("y")
    pair = y.withColumn("by", F.lag("y").over(w)).withColumn("bv", F.lag("v").over(w)).where("by = y - 1")
    return pair.select("entity_id", "y", (F.col("v") >= F.col("bv") * 1.2).alias("grew"))


@query("w6_keep_best", "SELECT lead, id FROM (SELECT *, row_number() OVER (PARTITION BY lead ORDER BY score DESC, id DESC) AS n FROM deals) WHERE n = 1")
def keep_best(t: Tables) -> DataFrame:
    return t.deals().groupBy("lead").agg(F.max_by("id", F.struct("score", "id")).alias("id"))


@query("w8_change_detection", "SELECT id, before, stage FROM (SELECT id, stage, lag(stage) OVER (PARTITION BY lead ORDER BY updated_at, id) AS before FROM deals) WHERE before <> stage")
def changes(t: Tables) -> DataFrame:
    w = Window.partitionBy("lead").orderBy("updated_at", "id")
    return t.deals().withColumn("before", F.lag("stage").over(w)).where("before <> stage").select("id", "before", "stage")


@query("w10_canonical_job", "SELECT category, max_by(city, (n * 10 + CASE WHEN won > 0 THEN 5 ELSE 0 END, city)) AS city FROM (SELECT category, city, count(*) AS n, count(*) FILTER (stage = 'won') AS won FROM deals GROUP BY ALL) GROUP BY category")
def canonical_job(t: Tables) -> DataFrame:
    g = t.deals().groupBy("category", "city").agg(F.count("*").alias("n"), F.count_if(F.col("stage") == "won").alias("won"))
    return g.groupBy("category").agg(F.max_by("city", F.struct(F.col("n") * 10 + F.when(F.col("won") > 0, 5).otherwise(0), F.col("city"))).alias("city"))


# Ranking and scores


@query("q_ranked_companies", """, f AS (SELECT * FROM ent WHERE entity_type = 'company' AND id IN (SELECT entity_id FROM obs WHERE attribute = 'revenue' AND value_num > 150000) AND id IN (SELECT source_id FROM rel JOIN ent t ON t.id = target_id WHERE relationship_type = 'located_in' AND t.entity_type = 'location' AND contains(lower(t.name), 'a')) ORDER BY last_seen_at DESC NULLS FIRST, id LIMIT 200),
c AS (SELECT f.*, (SELECT count(*) FROM ev WHERE entity_id = f.id) AS e, (SELECT count(*) FROM rel WHERE source_id = f.id) AS r, (SELECT count(*) FROM obs WHERE entity_id = f.id) AS o, epoch(TIMESTAMP '2001-08-02') - epoch(last_seen_at) AS age FROM f)
SELECT id, name, CAST(least(100, 35 + CASE WHEN age <= 604800 THEN 12 WHEN age <= 2592000 THEN 8 WHEN age <= 7776000 THEN 4 ELSE 0 END + CASE WHEN contains(lower(city), 'nation_6') THEN 10 ELSE 0 END + CASE WHEN contains(lower(category), 'building') THEN 8 ELSE 0 END + least(20, e * 4) + least(12, r * 2) + least(10, o // 2) + floor(confidence * 5 + 0.5)) AS BIGINT) AS score FROM c""")
def ranked(t: Tables) -> DataFrame:
    found = stored(execute(FLAGSHIP, t.entities(), t.observations(), t.relationships(), t.events()), "found")  # 200 rows at most
    counted = graph.with_counts(found, t.events(), t.relationships(), t.observations(), few=True)
    return counted.select("id", "name", graph.rank_score(as_of(), "nation_6", "building").alias("score"))


@query("r7_intent_score", """, sig AS (SELECT entity_id, list_sort(list(DISTINCT event_type)) AS kinds, count(*) FILTER (occurred_at > TIMESTAMP '2024-01-24') AS recent FROM ev GROUP BY entity_id),
b AS (SELECT entity_id, (CASE WHEN list_contains(kinds, 'purchase') AND list_contains(kinds, 'signup') THEN 35 ELSE 0 END + CASE WHEN list_contains(kinds, 'purchase') THEN 25 ELSE 0 END + CASE WHEN list_contains(kinds, 'signup') THEN 15 ELSE 0 END + CASE WHEN list_contains(kinds, 'error') THEN 5 ELSE 0 END) * CASE WHEN recent >= 3 THEN 1.2 ELSE 1.0 END AS s FROM sig)
SELECT entity_id, CAST(least(100, floor(s + 0.5)) AS BIGINT) AS score, CASE WHEN least(100, floor(s + 0.5)) >= 80 THEN 'hot' WHEN floor(s + 0.5) >= 60 THEN 'warm' WHEN floor(s + 0.5) >= 30 THEN 'tepid' ELSE 'cold' END AS label FROM b""")
def intent_score(t: Tables) -> DataFrame:
    g = t.events().groupBy("entity_id").agg(F.collect_set("event_type").alias("kinds"), F.count_if(F.col("occurred_at") > F.lit("2024-01-24").cast("timestamp")).alias("recent"))
    has = lambda k: F.array_contains("kinds", k)
    points = F.when(has("purchase") & has("signup"), 35).otherwise(0) + F.when(has("purchase"), 25).otherwise(0) + F.when(has("signup"), 15).otherwise(0) + F.when(has("error"), 5).otherwise(0)
    score = C.clamp(points * F.when(F.col("recent") >= 3, 1.2).otherwise(1.0)).cast("long")
    return g.select("entity_id", score.alias("score")).withColumn("label", C.intent_label(F.col("score")))


@query("r17_stage_board", "SELECT stage, count(*) AS n, round(sum(deal_value), 2) AS value FROM deals GROUP BY stage")
def stage_board(t: Tables) -> DataFrame:
    return t.deals().groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("deal_value"), 2).alias("value"))


# Set operations


@query("u2_union_first_wins", "SELECT id, min_by(src, pri) AS src FROM (SELECT id, 'a' AS src, 1 AS pri FROM ent WHERE city = 'NATION_6' UNION ALL SELECT id, 'b', 2 FROM ent WHERE confidence >= 0.9) GROUP BY id")
def union_first(t: Tables) -> DataFrame:
    a = t.entities().where("city = 'NATION_6'").select("id", F.lit("a").alias("src"), F.lit(1).alias("pri"))
    b = t.entities().where("confidence >= 0.9").select("id", F.lit("b").alias("src"), F.lit(2).alias("pri"))
    return a.unionByName(b).groupBy("id").agg(F.min_by("src", "pri").alias("src"))


@query("u3_overlay", "SELECT coalesce(a.lead, b.lead) AS lead, coalesce(b.s, a.s) AS stage FROM (SELECT lead, min(stage) AS s FROM deals WHERE score < 50 GROUP BY lead) a FULL JOIN (SELECT lead, max(stage) AS s FROM deals WHERE score >= 50 GROUP BY lead) b ON a.lead = b.lead")
def overlay(t: Tables) -> DataFrame:
    a = t.deals().where("score < 50").groupBy("lead").agg(F.min("stage").alias("old"))
    b = t.deals().where("score >= 50").groupBy("lead").agg(F.max("stage").alias("new"))
    return a.join(b, "lead", "full").select("lead", F.coalesce("new", "old").alias("stage"))


@query("u5_distinct_first", "SELECT host, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '://(?:www\\.)?([^/?#]*)', 1) AS host FROM pages) GROUP BY host")
def distinct_first(t: Tables) -> DataFrame:
    return t.raw("pages").groupBy(C.normalize_domain(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"))


@query("u6_except", "SELECT entity_id FROM ev EXCEPT SELECT id FROM ent")
def except_(t: Tables) -> DataFrame:
    return t.events().select("entity_id").distinct().join(t.entities().select(F.col("id").alias("entity_id")), "entity_id", "left_anti")


@query("u7_action_union", "SELECT 'stagnant' AS action, count(*) AS n FROM deals WHERE stage = 'active' AND updated_at < TIMESTAMP '2001-07-26' UNION ALL SELECT 'hot_new', count(*) FROM deals WHERE stage = 'active' AND score >= 70 UNION ALL SELECT 'stale', count(*) FROM ent WHERE last_seen_at < TIMESTAMP '2001-05-04'")
def actions(t: Tables) -> DataFrame:
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("action"), "n")

    d = t.deals().where("stage = 'active'")
    return counted(d.where(C.days_between(as_of(), F.col("updated_at")) > 7), "stagnant").unionByName(counted(d.where("score >= 70"), "hot_new")).unionByName(counted(t.entities().where(C.days_between(as_of(), F.col("last_seen_at")) > 90), "stale"))


# Scalar functions over pages, names and vectors


@query("f1_domain", "SELECT page_id, regexp_extract(lower(url), '://(?:www\\.)?([^/?#:]*)', 1) AS domain FROM pages")
def domains(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", C.normalize_domain(F.col("url")).alias("domain"))


@query("f6_slugs", "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\\s+', '-', 'g'), '[^a-z0-9\\-]', '', 'g'), '-+', '-', 'g'), '-') AS slug FROM ent")
def slugs(t: Tables) -> DataFrame:
    return t.entities().select("id", C.slug_name(F.col("name")).alias("slug"))


@query("f13_html_strip", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def html_strip(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.md5(C.strip_html(F.col("html"))).alias("text_md5"))


@query("f22_freshness_score", "SELECT id, CAST(CASE WHEN last_seen_at IS NULL THEN 0 ELSE greatest(0, least(100, floor(100 - (epoch(TIMESTAMP '2001-08-02') - epoch(last_seen_at)) / 86400 / 30 * 100 + 0.5))) END AS BIGINT) AS freshness FROM ent")
def freshness_score(t: Tables) -> DataFrame:
    return t.entities().select("id", C.freshness(C.days_between(as_of(), F.col("last_seen_at"))).alias("freshness"))


@query("f29_payload_hash", "SELECT id, md5(payload) AS h FROM ev")
def payload_hash(t: Tables) -> DataFrame:
    return t.events().select("id", F.md5("payload").alias("h"))


@query("f31_stable_hash", "SELECT page_id, lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(url, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296), 36, 7)) AS h FROM pages", bound=False)
def stable_hashes(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.stable_hash(F.col("url")).alias("h"))


@query("f32_page_hash", "WITH x AS (SELECT page_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(html, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM pages) SELECT page_id, 'h' || lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 16)) AS h FROM x", bound=False)
def page_hashes(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.page_hash(F.col("html")).alias("h"))


@query("f36_hashed_vectors")
def hashed_vectors(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.hashed_vector()(F.col("text")).alias("embedding"))


@query("f33_day_keys", "SELECT id, entity_id || ':' || attribute || ':' || strftime(observed_at, '%Y-%m-%d') AS dedup_key FROM obs")
def day_keys(t: Tables) -> DataFrame:
    return t.observations().select("id", C.day_key(F.col("entity_id"), F.col("attribute"), at=F.col("observed_at")).alias("dedup_key"))


@query("f38_vector_top_k", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 4) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, vec_id LIMIT 10", bound=False)
def vector_top_k(t: Tables) -> DataFrame:
    """One query vector against all rows; only the top rows of each task travel."""
    v = t.raw("embeddings")
    one = F.broadcast(v.where("vec_id = 7").limit(1).select(F.col("embedding").alias("e")))
    scored = v.join(one).select("vec_id", C.cosine(F.col("embedding"), F.col("e")).alias("s"))
    return scored.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 4).alias("similarity"))


@query("d1_contact_pages", "SELECT page_id FROM pages WHERE contains(html, '<form') OR regexp_matches(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[a-z]+')", bound=False)
def contact_gate(t: Tables) -> DataFrame:
    return t.raw("pages").where(F.contains("html", F.lit("<form")) | F.col("html").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+")).select("page_id")


@query("n45_page_flags", "SELECT page_id, contains(lower(html), 'viewport') AS has_viewport, contains(lower(html), '<script') AS has_script, regexp_matches(html, '(?i)<title[^>]*>[^<]') AS has_title FROM pages", bound=False)
def page_flags(t: Tables) -> DataFrame:
    h = F.lower("html")
    return t.raw("pages").select("page_id", F.contains(h, F.lit("viewport")).alias("has_viewport"), F.contains(h, F.lit("<script")).alias("has_script"), F.col("html").rlike(r"(?i)<title[^>]*>[^<]").alias("has_title"))


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


@query(
    "a25_review_sentiment",
    f"""WITH w AS (SELECT doc_id, source, doc_id % 6 AS stars, regexp_extract_all(lower(coalesce(text, '')), '[a-zàèéìòù'']+') AS ws FROM documents
    ), u AS (SELECT doc_id, unnest(list_zip(ws, list_prepend(NULL, ws))) AS p FROM w
    ), s AS (SELECT doc_id, sum(CASE WHEN p[1] IN ({_in(X.POSITIVE)}) THEN 1.0::DOUBLE WHEN p[1] IN ({_in(X.NEGATIVE)}) THEN -1.0 ELSE 0.0 END
      * CASE WHEN p[2] IN ({_in(X.NEGATIONS)}) THEN -1.0 ELSE 1.0 END * CASE WHEN p[2] IN ({_in(X.INTENSIFIERS)}) THEN 1.5 ELSE 1.0 END) AS total FROM u GROUP BY doc_id
    ), f AS (SELECT source, stars, coalesce(total, 0.0) / greatest(3.0, abs(coalesce(total, 0.0))) AS said FROM w LEFT JOIN s USING (doc_id)
    ), g AS (SELECT source, round(CASE WHEN stars BETWEEN 1 AND 5 THEN said * 0.6 + (stars - 3) / 2.0::DOUBLE * 0.4 ELSE said END, 3) AS score FROM f
    ), h AS (SELECT source, count(*) AS reviews, round(avg(score), 3) AS score FROM g GROUP BY source)
    SELECT source, reviews, score, CASE WHEN score > 0.25 THEN 'positive' WHEN score < -0.25 THEN 'negative' ELSE 'neutral' END AS label FROM h""",
    bound=False,
)
def review_sentiment(t: Tables) -> DataFrame:
    """Mean sentiment and label of each source; scores are made in the scan, so that only sums are shuffled."""
    scored = t.raw("documents").select("source", X.sentiment(F.col("text"), F.col("doc_id") % 6).alias("score"))
    mean = scored.groupBy("source").agg(F.count("*").alias("reviews"), F.round(F.avg("score"), 3).alias("score"))
    return mean.withColumn("label", X.sentiment_label(F.col("score")))


@query("n24_mail_policy", "WITH r AS (SELECT s_suppkey, s_suppkey % 3 AS k FROM supplier) SELECT s_suppkey, CASE k WHEN 0 THEN 'missing' WHEN 1 THEN 'warning' ELSE 'ok' END AS spf, CASE k WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' ELSE 'warning' END AS dmarc FROM r", bound=False)
def mail_policies(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    records = F.when(k == 0, F.array(F.lit("note"), F.lit("v=DMARC1; p=reject"))).when(k == 1, F.array(F.lit("V=SPF1 +all"))).otherwise(F.array(F.lit("v=spf1 -all"), F.lit("v=dmarc1; P=None")))
    return t.raw("supplier").select("s_suppkey", X.mail_policy(records, "spf").alias("spf"), X.mail_policy(records, "dmarc").alias("dmarc"))


_SNIPPET_WORDS = ["title", "href", "casino"]


@query(
    "n42_keyword_snippets",
    """WITH k AS (SELECT * FROM (VALUES ('title'), ('href'), ('casino')) AS v(keyword)), x AS (SELECT page_id, html, keyword, instr(lower(html), keyword) AS pos FROM pages, k)
    SELECT page_id, keyword, regexp_replace(replace(substr(html, greatest(1, pos - 40), pos - greatest(1, pos - 40) + length(keyword) + 60), chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS snippet FROM x WHERE pos > 0""",
    bound=False,
)
def snippets(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", F.inline(X.keyword_snippets(F.col("html"), _SNIPPET_WORDS)))


@query("n44_site_builder", """SELECT page_id, CASE WHEN regexp_matches(lower(html), '/wp-content/|/wp-includes/|name="generator" content="wordpress|wp-emoji-release[.]min[.]js') THEN 'WordPress' WHEN regexp_matches(lower(html), 'wix[.]com|x-wix-request-id|wixsite|wixdata|wix-ui|id=["'']comp-| comp-') THEN 'Wix' WHEN contains(lower(html), 'shopify') THEN 'Shopify' WHEN contains(lower(html), 'squarespace') THEN 'Squarespace' ELSE 'Custom HTML' END AS builder FROM pages""", bound=False)
def site_builders(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", X.site_builder(F.col("html")).alias("builder"))


@query("n31_options", "SELECT DISTINCT category FROM ent WHERE category IS NOT NULL")
def options(t: Tables) -> DataFrame:
    return t.entities().where("category is not null").select("category").distinct()


@query("n34_modal_source", "SELECT entity_id, source FROM (SELECT entity_id, source, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, source) AS n FROM obs GROUP BY entity_id, source) WHERE n = 1")
def modal_source(t: Tables) -> DataFrame:
    g = t.observations().groupBy("entity_id", "source").agg(F.count("*").alias("n"))
    return g.groupBy("entity_id").agg(F.min_by("source", F.struct((-F.col("n")).alias("n"), "source")).alias("source"))


# Lifecycle and events


@query("m2_merge_entities", ", m AS (SELECT id, CASE WHEN id LIKE 's:%7' THEN 's:' || (CAST(substr(id, 3) AS BIGINT) + 2) WHEN id LIKE 's:%8' THEN 's:' || (CAST(substr(id, 3) AS BIGINT) + 1) ELSE id END AS f FROM ent) SELECT f AS source_id, target_id, max(confidence) AS confidence FROM rel JOIN m ON source_id = m.id WHERE relationship_type = 'sells_to' AND f <> target_id GROUP BY f, target_id")
def merge_entities(t: Tables) -> DataFrame:
    final = graph.resolve_merges(t.entities())
    e = t.relationships().where("relationship_type = 'sells_to'").join(final, F.col("source_id") == F.col("id"))
    return e.where("final_id <> target_id").groupBy(F.col("final_id").alias("source_id"), "target_id").agg(F.max("confidence").alias("confidence"))


@query("e8_snapshot_changes", "SELECT id, abs(value - before) >= 5 AS jumped FROM (SELECT id, value, lag(value) OVER (PARTITION BY entity_id ORDER BY occurred_at, id) AS before FROM ev) WHERE before IS NOT NULL")
def snapshot_changes(t: Tables) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("occurred_at", "id")
    return t.events().withColumn("before", F.lag("value").over(w)).where("before is not null").select("id", (F.abs(F.col("value") - F.col("before")) >= 5).alias("jumped"))


@query("e9_retention", "SELECT date_trunc('month', occurred_at)::DATE AS month, count(*) AS archived FROM ev WHERE processed AND occurred_at < TIMESTAMP '2024-01-01' + INTERVAL 10 DAY GROUP BY 1")
def retention(t: Tables) -> DataFrame:
    old = t.events().where("processed and occurred_at < timestamp '2024-01-11'")
    return old.groupBy(F.to_date(F.date_trunc("month", "occurred_at")).alias("month")).agg(F.count("*").alias("archived"))


@query("e_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, occurred_at) AS start, event_type, count(*) AS n FROM ev GROUP BY 1, 2")
def tumbling(t: Tables) -> DataFrame:
    return t.events().groupBy(F.window("occurred_at", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
