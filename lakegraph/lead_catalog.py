"""Queries of the lead operators over whole tables, each with SQL that gives the same rows; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph import catalog
from lakegraph.functions import columns as C
from lakegraph.functions import leads as L
from lakegraph.operators import ingest as I
from lakegraph.operators import matching as M
from lakegraph.sources.leads import LEAD_SQL, leads, signals
from lakegraph.sources.tables import Tables


def query(name: str, sql: str | None = None):
    return catalog.query(name, LEAD_SQL + sql if sql else None, bound=False)


def half_up_sql(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS BIGINT)"


# Predicates over leads

WANTED = L.LeadFilter(tag_manager=False, meta_pixel=False, ssl=True, speed="slow", instagram=False, revenue_min=500_000, employees_max=100, founded_after="1960-01-01")


@query("p14_technical_filter", "SELECT id FROM lead WHERE tag_manager IS DISTINCT FROM true AND meta_pixel IS NOT DISTINCT FROM true AND ssl IS DISTINCT FROM true AND coalesce(load_seconds, 0) <= 3")
def technical_filter(t: Tables) -> DataFrame:
    return leads(t).where(L.technical_match(L.LeadFilter(tag_manager=False, meta_pixel=True, ssl=False, speed="fast"))).select("id")


@query("p15_social_filter", "SELECT id FROM lead WHERE coalesce(instagram, '') NOT IN ('', 'N/D') AND rating > 0 AND rating < 4")
def social_filter(t: Tables) -> DataFrame:
    return leads(t).where(L.social_match(L.LeadFilter(instagram=True, bad_reviews=True))).select("id")


@query("p16_business_filter", "SELECT id FROM lead WHERE (coalesce(revenue, 0) <= 0 OR revenue >= 500000) AND coalesce(employees, 0) <= 100 AND (founded IS NULL OR founded >= '1960-01-01')")
def business_filter(t: Tables) -> DataFrame:
    return leads(t).where(L.business_match(L.LeadFilter(revenue_min=500_000, employees_max=100, founded_after="1960-01-01"))).select("id")


@query("p17_intent_filter", "SELECT id, name FROM lead WHERE tag_manager IS DISTINCT FROM true AND meta_pixel IS DISTINCT FROM true AND ssl IS DISTINCT FROM false AND load_seconds > 3 AND coalesce(instagram, '') IN ('', 'N/D') AND (coalesce(revenue, 0) <= 0 OR revenue >= 500000) AND coalesce(employees, 0) <= 100 AND (founded IS NULL OR founded >= '1960-01-01')")
def intent_filter(t: Tables) -> DataFrame:
    return leads(t).where(L.lead_match(WANTED)).select("id", "name")


@query("p18_strict_filter", "SELECT id FROM lead WHERE tag_manager IS DISTINCT FROM true AND ssl IS NOT DISTINCT FROM false AND coalesce(revenue, 0) >= 500000 AND coalesce(employees, 0) >= 10")
def strict_filter(t: Tables) -> DataFrame:
    return leads(t).where(L.strict_lead_match(L.LeadFilter(tag_manager=False, ssl=False, revenue_min=500_000, employees_min=10))).select("id")


@query("p19_any_gap", "SELECT id FROM lead WHERE coalesce(site, 'N/D') <> 'N/D' AND (meta_pixel IS DISTINCT FROM true OR ssl = false OR seo_errors = true OR mobile = false)")
def any_gap(t: Tables) -> DataFrame:
    return leads(t).where(L.present(F.col("site")) & (L.gap_text() != "") & (~L.is_true(F.col("meta_pixel")) | F.col("ssl").eqNullSafe(False) | L.is_true(F.col("seo_errors")) | F.col("mobile").eqNullSafe(False))).select("id")


@query("p20_signal_requirements", "SELECT id FROM lead WHERE id IN (SELECT lead FROM sig WHERE kind = 'purchase' AND confidence >= 60) AND id IN (SELECT lead FROM sig WHERE kind = 'click' AND age_hours <= 48)")
def signal_requirements(t: Tables) -> DataFrame:
    s = signals(t)
    wanted = s.groupBy("lead").agg(F.bool_or((F.col("kind") == "purchase") & (F.col("confidence") >= 60)).alias("bought"), F.bool_or((F.col("kind") == "click") & (F.col("age_hours") <= 48)).alias("clicked"))
    return leads(t).join(wanted.where("bought and clicked"), F.col("id") == F.col("lead"), "left_semi").select("id")


@query("p21_signal_filter_or_all", "SELECT id FROM lead WHERE id IN (SELECT lead FROM sig WHERE kind = 'no such kind') OR NOT EXISTS (SELECT 1 FROM lead JOIN sig ON lead.id = sig.lead WHERE kind = 'no such kind')")
def signal_filter_or_all(t: Tables) -> DataFrame:
    rows = leads(t)
    hits = rows.join(signals(t).where("kind = 'no such kind'").select("lead"), F.col("id") == F.col("lead"), "left_semi")
    return (rows if hits.isEmpty() else hits).select("id")


CONTACT_SQL = "(coalesce(phone, 'N/D') <> 'N/D' OR (contains(email, '@') AND split_part(email, '@', 2) <> 'example.com'))"


@query("p22_contact_gate", f"SELECT id FROM lead WHERE {CONTACT_SQL}")
def contact_gate(t: Tables) -> DataFrame:
    return leads(t).where(L.has_contact(F.col("phone"), F.col("email"))).select("id")


@query("p24_relevance_gate", "SELECT count(*) AS n, count(*) FILTER (category = 'BUILDING') AS fit, CASE WHEN count(*) = 0 THEN true WHEN count(*) <= 4 THEN count(*) FILTER (category = 'BUILDING') >= ceil(count(*) * 0.5) ELSE count(*) FILTER (category = 'BUILDING') > 0.25 * count(*) END AS relevant FROM lead")
def relevance_gate(t: Tables) -> DataFrame:
    fit = leads(t).agg(F.count("*").alias("n"), F.count_if(F.col("category") == "BUILDING").alias("fit"))
    return fit.withColumn("relevant", F.when(F.col("n") == 0, True).when(F.col("n") <= 4, F.col("fit") >= F.ceil(F.col("n") * 0.5)).otherwise(F.col("fit") > F.col("n") * 0.25))


@query("p26_include_exclude", "SELECT id FROM lead WHERE list_has_all(tech_stack, ['wordpress', 'ga4']) AND NOT list_has_any(tech_stack, ['shopify']) AND rating >= 3 AND load_seconds <= 5 AND contains(lower(concat_ws(' ', name, site, email, phone, city, category)), 'nation_1')")
def include_exclude(t: Tables) -> DataFrame:
    blob = F.concat_ws(" ", "name", "site", "email", "phone", "city", "category")
    fit = L.include_exclude(F.col("tech_stack"), ["wordpress", "ga4"], ["shopify"])
    return leads(t).where(fit & L.between_known(F.col("rating"), low=3) & L.between_known(F.col("load_seconds"), high=5) & C.contains_ci(blob, "nation_1")).select("id")


@query("p27_pixel_and_score", "SELECT id, score FROM lead WHERE meta_pixel IS DISTINCT FROM true AND score >= 60")
def pixel_and_score(t: Tables) -> DataFrame:
    return leads(t).where(~L.is_true(F.col("meta_pixel")) & (F.col("score") >= 60)).select("id", "score")


@query("p28_category_variants", "SELECT id, category FROM lead WHERE category ILIKE '%build%' OR category ILIKE '%furn%'")
def category_variants(t: Tables) -> DataFrame:
    return leads(t).where(C.contains_ci(F.col("category"), "build") | C.contains_ci(F.col("category"), "furn")).select("id", "category")


@query("p29_market_filter", "SELECT id, score FROM lead WHERE contains(lower(category), 'auto') AND contains(lower(city), 'nation_1') AND score >= 40")
def market_filter(t: Tables) -> DataFrame:
    return leads(t).where(L.market_match("auto", "nation_1", 40)).select("id", "score")


@query("p30_site_presence", "SELECT id, coalesce(site, 'N/D') <> 'N/D' AS has_site FROM lead")
def site_presence(t: Tables) -> DataFrame:
    return leads(t).select("id", L.present(F.col("site")).alias("has_site"))


# Joins

DOMAIN_SQL = "CASE WHEN coalesce(site, 'N/D') <> 'N/D' THEN regexp_replace(site, '^https://www\\.([^/]*)/.*$', '\\1') END"


def host(site: Column) -> Column:
    return F.when(L.present(site), C.normalize_domain(site))


@query("j17_site_or_name", f"SELECT id, coalesce((SELECT min(p_partkey) FROM part WHERE site = 'https://www.shop' || (p_partkey % 400) || '.it/home'), (SELECT min(s_suppkey) FROM supplier WHERE lower(trim(replace(s_name, 'Supplier', 'Customer'))) = lower(trim(name)))) AS deal FROM lead")
def site_or_name(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    by_site = t.raw("part").select(F.col("p_partkey").alias("deal"), F.expr("'https://www.shop' || (p_partkey % 400) || '.it/home'").alias("site"), none.alias("name"))
    by_name = t.raw("supplier").select(F.col("s_suppkey").alias("deal"), none.alias("site"), F.expr("replace(s_name, 'Supplier', 'Customer')").alias("name"))
    return M.by_site_or_name(leads(t), by_site.unionByName(by_name))


@query("j20_suffix_match", "SELECT p.page_id, l.host AS site FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) p JOIN (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages WHERE contains(url, '://')) l ON contains(p.host, '.') AND contains(l.host, '.') AND (p.host = l.host OR ends_with(p.host, '.' || l.host) OR ends_with(l.host, '.' || p.host))")
def suffix_match(t: Tables) -> DataFrame:
    """Each page with its site and with the sites that it lies under or that lie under it."""
    page = t.raw("pages").select(F.col("page_id").alias("id"), F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)).alias("host"))
    sites = page.where(F.contains("host", F.lit("."))).select(F.col("host").alias("id"), "host").distinct()
    return M.suffix_matches(page, sites).select(F.col("left_id").alias("page_id"), F.col("right_id").alias("site"))


@query("j22_hydrate", f"SELECT l.id, coalesce(l.phone, d.phone) AS phone, coalesce(l.email, d.email) AS email FROM lead l LEFT JOIN (SELECT {DOMAIN_SQL} AS host, max(phone) AS phone, max(email) AS email FROM lead WHERE coalesce(site, 'N/D') <> 'N/D' GROUP BY 1) d ON CASE WHEN coalesce(l.site, 'N/D') <> 'N/D' THEN regexp_replace(l.site, '^https://www\\.([^/]*)/.*$', '\\1') END = d.host")
def hydrate(t: Tables) -> DataFrame:
    rows = leads(t).select("id", "phone", "email", host(F.col("site")).alias("host"))
    known = rows.where("host is not null").groupBy("host").agg(F.max("phone").alias("phone"), F.max("email").alias("email"))
    return M.fill_blanks(rows, known, ["host"], ["phone", "email"]).select("id", "phone", "email")


def _leads_and_records(t: Tables) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    a = leads(t).select("id", "name", "city", none.alias("vat"), host(F.col("site")).alias("domain"), F.when(L.present(F.col("phone")), F.col("phone")).alias("phone"))
    s = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    b = s.select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.expr("replace(s_name, 'Supplier', 'Customer')").alias("name"), F.col("n_name").alias("city"), none.alias("vat"), F.expr("'shop' || s_suppkey || '.it'").alias("domain"), none.alias("phone"))
    return a, b


@query("j18_company_match")
def company_match(t: Tables) -> DataFrame:
    return M.match_companies(*_leads_and_records(t))


@query("j18_exact_matches", """, ld AS (SELECT id, name, lower(city) AS city, CASE WHEN coalesce(site, 'N/D') <> 'N/D' THEN regexp_replace(site, '^https://www\\.([^/]*)/.*$', '\\1') END AS d FROM lead),
  rc AS (SELECT 's:' || s_suppkey AS id, replace(s_name, 'Supplier', 'Customer') AS name, lower(n_name) AS city, 'shop' || s_suppkey || '.it' AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey)
  SELECT ld.id AS lead_id, rc.id AS record_id, 'domain' AS reason FROM ld JOIN rc ON ld.d = rc.d UNION ALL SELECT ld.id, rc.id, 'name and city' FROM ld JOIN rc ON ld.name = rc.name WHERE ld.d IS DISTINCT FROM rc.d AND (contains(ld.city, rc.city) OR contains(rc.city, ld.city))""")
def exact_matches(t: Tables) -> DataFrame:
    """Accepted pairs that identities or equal names decide; names that are only alike needn't be looked for."""
    return M.match_companies(*_leads_and_records(t), letters=False).where(F.col("accepted") & F.col("reason").isin("domain", "name and city")).select("lead_id", "record_id", "reason")


# Aggregates and ranks


@query("a5_search_quality", f"SELECT kind, count(*) AS n, {half_up_sql('count(*) FILTER (confidence >= 70) * 100.0 / count(*)')} AS positive_rate, {half_up_sql('count(*) FILTER (confidence < 30) * 100.0 / count(*)')} AS negative_rate FROM sig GROUP BY kind")
def search_quality(t: Tables) -> DataFrame:
    def rate(test: Column) -> Column:
        return C.half_up(F.count_if(test) * 100 / F.count("*")).cast("long")

    return signals(t).groupBy("kind").agg(F.count("*").alias("n"), rate(F.col("confidence") >= 70).alias("positive_rate"), rate(F.col("confidence") < 30).alias("negative_rate"))


@query("a10_outreach", f"SELECT city, count(*) AS contacted, count(*) FILTER (score >= 50) AS replied, count(*) FILTER (score >= 80) AS interested, {half_up_sql('count(*) FILTER (score >= 50) * 100.0 / count(*)')} AS reply_rate FROM lead WHERE {CONTACT_SQL} GROUP BY city")
def outreach(t: Tables) -> DataFrame:
    rows = leads(t).where(L.has_contact(F.col("phone"), F.col("email")))
    return rows.groupBy("city").agg(F.count("*").alias("contacted"), F.count_if(F.col("score") >= 50).alias("replied"), F.count_if(F.col("score") >= 80).alias("interested"), C.half_up(F.count_if(F.col("score") >= 50) * 100 / F.count("*")).cast("long").alias("reply_rate"))


@query("a18_forecast", "SELECT category, won, closed, CASE WHEN closed < 3 THEN 25.0::DOUBLE ELSE won * 100.0::DOUBLE / closed END AS win_rate, CASE WHEN closed >= 10 THEN 'high' WHEN closed >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT category, count(*) FILTER (o_orderstatus = 'F') AS won, count(*) FILTER (o_orderstatus IN ('F', 'P')) AS closed FROM orders JOIN lead ON lead.id = 'c:' || o_custkey GROUP BY category)")
def forecast(t: Tables) -> DataFrame:
    d = t.deals().groupBy("category").agg(F.count_if(F.col("stage") == "won").alias("won"), F.count_if(F.col("stage") != "active").alias("closed"))
    rate = F.when(F.col("closed") < 3, 25.0).otherwise(F.col("won") * 100.0 / F.col("closed"))
    return d.select("*", rate.alias("win_rate"), F.when(F.col("closed") >= 10, "high").when(F.col("closed") >= 3, "medium").otherwise("low").alias("confidence"))


@query(
    "a21_feedback_profile",
    """, nw AS (SELECT 'c:' || user_id AS lead, event_id AS id, event_type AS kind, props, 10 + event_id % 91 AS confidence, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events QUALIFY r <= 500),
 ac AS (SELECT lead, list(kind || ':' || n ORDER BY n DESC, kind)[1:5] AS top_actions FROM (SELECT lead, kind, count(*) AS n FROM nw GROUP BY lead, kind) GROUP BY lead),
 qu AS (SELECT lead, list(props ORDER BY f)[1:20] AS recent_queries FROM (SELECT lead, props, min(r) AS f FROM nw WHERE props <> '' GROUP BY lead, props) GROUP BY lead)
 SELECT lead, list_sort(list(DISTINCT id) FILTER (confidence >= 70)) AS liked, list_sort(list(DISTINCT id) FILTER (confidence < 30)) AS disliked, count(*) AS n, any_value(top_actions) AS top_actions, any_value(recent_queries) AS recent_queries
 FROM nw JOIN ac USING (lead) LEFT JOIN qu USING (lead) GROUP BY lead""",
)
def feedback_profile(t: Tables) -> DataFrame:
    """The newest 500 rows of each lead, as the reference's feature has it: liked and disliked ids (null where none), the five
    most frequent actions, the twenty newest distinct queries."""
    w = Window.partitionBy("lead").orderBy(F.desc("seen_at"), F.desc("id"))
    rows = signals(t).join(t.raw("events").select(F.col("event_id").alias("id"), "props"), "id")
    newest = rows.withColumn("r", F.row_number().over(w)).where("r <= 500")

    def ids(test: Column) -> Column:
        found = F.array_sort(F.collect_set(F.when(test, F.col("id"))))
        return F.when(F.size(found) > 0, found)

    def first(found: Column, most: int) -> Column:
        return F.transform(F.slice(F.array_sort(found), 1, most), lambda x: x["v"])

    sides = newest.groupBy("lead").agg(ids(F.col("confidence") >= 70).alias("liked"), ids(F.col("confidence") < 30).alias("disliked"), F.count("*").alias("n"))
    actions = newest.groupBy("lead", "kind").agg(F.count("*").alias("k"))
    actions = actions.groupBy("lead").agg(first(F.collect_list(F.struct((-F.col("k")).alias("k"), "kind", F.concat_ws(":", "kind", F.col("k").cast("string")).alias("v"))), 5).alias("top_actions"))
    asked = newest.where("props <> ''").groupBy("lead", "props").agg(F.min("r").alias("f"))
    asked = asked.groupBy("lead").agg(first(F.collect_list(F.struct("f", F.col("props").alias("v"))), 20).alias("recent_queries"))
    return sides.join(actions, "lead").join(asked, "lead", "left")


@query("a23_contact_stats", f"SELECT count(*) AS total, count(*) FILTER ({CONTACT_SQL}) AS with_contact, count(*) FILTER (NOT coalesce({CONTACT_SQL}, false)) AS hidden FROM lead")
def contact_stats(t: Tables) -> DataFrame:
    has = L.has_contact(F.col("phone"), F.col("email"))
    return leads(t).agg(F.count("*").alias("total"), F.count_if(has).alias("with_contact"), F.count_if(~has).alias("hidden"))


@query("a24_adaptive_weights", "SELECT city, CASE WHEN n < 5 OR np < 2 OR nn < 2 OR abs(p - m) < 8 THEN 20.0::DOUBLE WHEN p > m THEN 20 * 1.04::DOUBLE ELSE 20 * 0.96::DOUBLE END AS weight FROM (SELECT city, count(*) AS n, count(*) FILTER (rating >= 4) AS np, count(*) FILTER (rating < 3) AS nn, avg(score) FILTER (rating >= 4) AS p, avg(score) FILTER (rating < 3) AS m FROM lead GROUP BY city)")
def adaptive_weights(t: Tables) -> DataFrame:
    good, bad = F.col("rating") >= 4, F.col("rating") < 3
    s = leads(t).groupBy("city").agg(F.count("*").alias("n"), F.count_if(good).alias("np"), F.count_if(bad).alias("nn"), F.avg(F.when(good, F.col("score"))).alias("p"), F.avg(F.when(bad, F.col("score"))).alias("m"))
    still = (F.col("n") < 5) | (F.col("np") < 2) | (F.col("nn") < 2) | (F.abs(F.col("p") - F.col("m")) < 8)
    factor = F.when(still, 1.0).when(F.col("p") > F.col("m"), 1.04).otherwise(0.96)
    return s.select("city", F.greatest(F.lit(3.0), F.least(F.lit(45.0), F.lit(20.0) * factor)).alias("weight"))


@query("w7_first_contact", "SELECT lead, min(seen_at) AS first_at, arg_min(kind, (seen_at, id)) AS first_kind FROM sig GROUP BY lead")
def first_contact(t: Tables) -> DataFrame:
    return signals(t).groupBy("lead").agg(F.min("seen_at").alias("first_at"), F.min_by("kind", F.struct("seen_at", "id")).alias("first_kind"))


@query("t5_audit_priority", "SELECT id, audited_days FROM lead WHERE coalesce(site, 'N/D') <> 'N/D' AND (audited_days IS NULL OR floor(greatest(0, 100 - audited_days / 30.0 * 100) + 0.5) <= 40) ORDER BY id IN (SELECT lead FROM sig WHERE kind = 'purchase') DESC, coalesce(audited_days, 1000000) DESC, id LIMIT 50")
def audit_priority(t: Tables) -> DataFrame:
    """Re-audit queue of fifty: monitored leads first, then the least fresh."""
    watched = signals(t).where("kind = 'purchase'").select(F.col("lead").alias("_lead")).distinct()
    rows = leads(t).where(L.needs_audit(F.col("audited_days"), F.col("site"))).join(watched, F.col("id") == F.col("_lead"), "left")
    return rows.orderBy(F.col("_lead").isNull(), F.coalesce("audited_days", F.lit(1_000_000)).desc(), "id").limit(50).select("id", "audited_days")


@query("t6_oldest_first", "SELECT id, audited_days FROM lead ORDER BY audited_days DESC NULLS FIRST, id LIMIT 30")
def oldest_first(t: Tables) -> DataFrame:
    return leads(t).orderBy(F.col("audited_days").desc_nulls_first(), "id").limit(30).select("id", "audited_days")


@query("n26_feedback_samples", "SELECT * FROM (SELECT 'signal' AS source, lead, confidence::DOUBLE AS score FROM sig ORDER BY seen_at DESC, id DESC LIMIT 80) UNION ALL SELECT * FROM (SELECT 'deal', 'c:' || o_custkey, (o_orderkey % 101)::DOUBLE FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)")
def feedback_samples(t: Tables) -> DataFrame:
    newest = signals(t).orderBy(F.desc("seen_at"), F.desc("id")).limit(80).select(F.lit("signal").alias("source"), "lead", F.col("confidence").cast("double").alias("score"))
    deals = t.deals().orderBy(F.desc("updated_at"), F.desc("id")).limit(50).select(F.lit("deal").alias("source"), F.concat(F.lit("c:"), "lead").alias("lead"), F.col("score").cast("double").alias("score"))
    return newest.unionByName(deals)


# Scores

STRENGTH_SQL = half_up_sql("greatest(0, least(100, confidence * greatest(0, (168 - age_hours) / 168.0::DOUBLE) * CASE tier WHEN 'official' THEN 1.0::DOUBLE WHEN 'inferred' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END))")


def strength() -> Column:
    return L.signal_strength(F.col("confidence"), F.col("age_hours"), F.col("tier"))


@query("r8_signal_strength", f"SELECT id, {STRENGTH_SQL} AS strength FROM sig")
def signal_strength(t: Tables) -> DataFrame:
    return signals(t).select("id", strength().alias("strength"))


@query("r15_strong_signals", f"SELECT lead, id, kind, {STRENGTH_SQL} AS strength FROM sig WHERE kind IN ('purchase', 'signup') AND {STRENGTH_SQL} >= 55")
def strong_signals(t: Tables) -> DataFrame:
    return signals(t).where(F.col("kind").isin("purchase", "signup")).withColumn("strength", strength()).where("strength >= 55").select("lead", "id", "kind", "strength")


@query("r5_opportunity", f"SELECT id, least(100, {half_up_sql('coalesce(mean, 0) * (CASE WHEN mean IS NULL THEN 0.4::DOUBLE ELSE 0.75::DOUBLE END) + score * (CASE WHEN mean IS NULL THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END)')}) AS opportunity FROM lead LEFT JOIN (SELECT lead, sum(best * n) / sum(n) AS mean FROM (SELECT lead, kind, max(confidence) AS best, count(*) AS n FROM sig GROUP BY lead, kind) GROUP BY lead) ON lead = id")
def opportunity(t: Tables) -> DataFrame:
    """A lead's best signal of each kind, weighed by how often it was seen; kinds are few, so the lists are short."""
    kinds = signals(t).groupBy("lead", "kind").agg(F.max("confidence").cast("double").alias("score"), F.count("*").cast("double").alias("confidence"))
    lists = kinds.groupBy("lead").agg(F.collect_list(F.struct("score", "confidence")).alias("scores"))
    rows = leads(t).join(lists, F.col("id") == F.col("lead"), "left")
    none = F.array().cast("array<struct<score:double,confidence:double>>")
    return rows.select("id", L.opportunity(F.coalesce("scores", none), F.col("score")).alias("opportunity"))


@query("r11_worker_opportunity", "SELECT id, least(100, CASE WHEN meta_pixel IS DISTINCT FROM true THEN 25 ELSE 0 END + CASE WHEN site IS NULL THEN 30 ELSE 0 END + CASE WHEN instagram IS NULL THEN 10 ELSE 0 END + CASE WHEN seo_errors THEN 15 ELSE 0 END + CASE WHEN dmarc = false THEN 10 ELSE 0 END + CASE WHEN load_seconds > 4 THEN 5 ELSE 0 END + CASE WHEN rating < 3.5 THEN 20 WHEN rating < 4 THEN 10 ELSE 0 END + CASE WHEN reviews < 10 THEN 5 ELSE 0 END)::BIGINT AS score FROM lead")
def worker_opportunity(t: Tables) -> DataFrame:
    return leads(t).select("id", L.worker_opportunity().alias("score"))


@query("r12_twin_opportunity", "SELECT id, least(100, CASE WHEN meta_pixel IS DISTINCT FROM true THEN 25 ELSE 0 END + CASE WHEN site IS NULL THEN 30 ELSE 0 END + CASE WHEN instagram IS NULL THEN 15 ELSE 0 END + CASE WHEN seo_errors THEN 20 ELSE 0 END + CASE WHEN dmarc = false THEN 10 ELSE 0 END)::BIGINT AS score FROM lead")
def twin_opportunity(t: Tables) -> DataFrame:
    return leads(t).select("id", L.twin_opportunity().alias("score"))


_STAGES_SQL = ["CASE o_orderstatus WHEN 'F' THEN 'vinto' WHEN 'P' THEN 'meeting' ELSE 'contattato' END AS current", "CASE left(o_orderpriority, 1) WHEN '1' THEN 'vinto' WHEN '2' THEN 'proposta' WHEN '3' THEN 'perso' WHEN '4' THEN 'meeting' ELSE 'nuovo' END AS proposed"]


@query("r17_stage_merge", f", o AS (SELECT o_orderkey AS id, {', '.join(_STAGES_SQL)} FROM orders), r(stage, r) AS (VALUES ('nuovo', 0), ('contattato', 1), ('meeting', 2), ('proposta', 3), ('vinto', 4), ('perso', 4)) SELECT id, CASE WHEN proposed IN ('vinto', 'perso') THEN proposed WHEN a.r < 4 AND b.r > a.r THEN proposed ELSE current END AS merged FROM o JOIN r a ON a.stage = current JOIN r b ON b.stage = proposed")
def stage_merge(t: Tables) -> DataFrame:
    """Every order's stage (from its status) after the one that its priority proposes."""
    rows = t.raw("orders").selectExpr("o_orderkey AS id", *_STAGES_SQL)
    return rows.select("id", L.merged_stage(F.col("current"), F.col("proposed")).alias("merged"))


# State over ordered rows


@query("e5_recent_buffer", "SELECT id, lead, kind FROM (SELECT DISTINCT id, lead, kind, seen_at FROM sig) ORDER BY seen_at DESC, id DESC LIMIT 50")
def recent_buffer(t: Tables) -> DataFrame:
    """The fifty newest events, each id once."""
    return signals(t).select("id", "lead", "kind", "seen_at").distinct().orderBy(F.desc("seen_at"), F.desc("id")).limit(50).select("id", "lead", "kind")


@query("e16_type_change", "SELECT id, lead, before, kind FROM (SELECT id, lead, kind, lag(kind) OVER (PARTITION BY lead ORDER BY seen_at, id) AS before FROM sig) WHERE before <> kind")
def type_change(t: Tables) -> DataFrame:
    """An alert where a company's newest signal is of another type than the one before."""
    order = Window.partitionBy("lead").orderBy("seen_at", "id")
    return signals(t).withColumn("before", F.lag("kind").over(order)).where("before <> kind").select("id", "lead", "before", "kind")


@query("n18_set_change", "SELECT lead, day, list_sort(before) AS before, list_sort(kinds) AS kinds FROM (SELECT *, lag(kinds) OVER (PARTITION BY lead ORDER BY day) AS before FROM (SELECT lead, CAST(seen_at AS DATE) AS day, list_sort(list(DISTINCT kind)) AS kinds FROM sig GROUP BY ALL)) WHERE before <> kinds")
def set_change(t: Tables) -> DataFrame:
    """Days on which the set of a lead's kinds differs from its last day's; a first day has nothing to differ from."""
    days = signals(t).groupBy("lead", F.to_date("seen_at").alias("day")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return days.withColumn("before", F.lag("kinds").over(Window.partitionBy("lead").orderBy("day"))).where("before <> kinds").select("lead", "day", "before", "kinds")


@query("n20_first_source", "SELECT lead, kind, id, tier FROM (SELECT *, row_number() OVER (PARTITION BY lead, kind ORDER BY CASE tier WHEN 'official' THEN 0 WHEN 'aggregator' THEN 1 WHEN 'inferred' THEN 2 ELSE 3 END, id) AS r FROM sig) WHERE r <= 2")
def first_sources(t: Tables) -> DataFrame:
    """The two sources to try first for each kind, by tier and then by id."""
    tier = F.when(F.col("tier") == "official", 0).when(F.col("tier") == "aggregator", 1).when(F.col("tier") == "inferred", 2).otherwise(3)
    order = Window.partitionBy("lead", "kind").orderBy(tier, "id")
    return signals(t).withColumn("r", F.row_number().over(order)).where("r <= 2").select("lead", "kind", "id", "tier")


@query("n39_stage_board", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'vinto' WHEN o_orderstatus = 'P' THEN 'perso' ELSE 'nuovo' END AS stage, count(*) AS deals, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def stage_board(t: Tables) -> DataFrame:
    """Deals and their value by stage; unknown stages count as the first."""
    stage = F.when(F.col("stage") == "won", "vinto").when(F.col("stage") == "lost", "perso").otherwise("nuovo")
    return t.deals().groupBy(stage.alias("stage")).agg(F.count("*").alias("deals"), F.round(F.sum("deal_value"), 2).alias("value"))


@query("n37_live_leads", "SELECT id, name FROM lead WHERE contains(lower(city), 'nation_1') AND contains(lower(category), 'mach') ORDER BY audited_days NULLS LAST, id LIMIT 200")
def live_leads(t: Tables) -> DataFrame:
    """The two hundred most freshly audited leads of a place and category."""
    return leads(t).where(L.market_match("mach", "nation_1")).orderBy(F.col("audited_days").asc_nulls_last(), "id").limit(200).select("id", "name")


@query("m5_feed_drafts", "SELECT 'closure' AS kind, 'Closed: ' || l.name AS title, concat_ws(' · ', l.category, l.city, 'score ' || (o_orderkey % 101)) AS body, 0.85::DOUBLE AS confidence FROM orders JOIN lead l ON l.id = 'c:' || o_custkey WHERE o_orderstatus = 'F' UNION ALL SELECT 'segment', 'Segment ' || city, count(*) || ' leads · ' || count(*) FILTER (meta_pixel IS DISTINCT FROM true) || ' without pixel', 0.7::DOUBLE FROM lead GROUP BY city")
def feed_drafts(t: Tables) -> DataFrame:
    """Drafts for the knowledge feed: won deals, and a line for each segment."""
    won = t.deals().where("stage = 'won'").withColumn("lead", F.concat(F.lit("c:"), "lead")).join(leads(t).select(F.col("id").alias("lead"), "name"), "lead")
    closures = won.select(F.lit("closure").alias("kind"), F.concat(F.lit("Closed: "), "name").alias("title"), F.concat_ws(" · ", "category", "city", F.concat(F.lit("score "), F.col("score").cast("string"))).alias("body"), F.lit(0.85).alias("confidence"))
    groups = leads(t).groupBy("city").agg(F.count("*").alias("n"), F.count_if(~L.is_true(F.col("meta_pixel"))).alias("bare"))
    segments = groups.select(F.lit("segment").alias("kind"), F.concat(F.lit("Segment "), "city").alias("title"), F.concat(F.col("n").cast("string"), F.lit(" leads · "), F.col("bare").cast("string"), F.lit(" without pixel")).alias("body"), F.lit(0.7).alias("confidence"))
    return closures.unionByName(segments)
