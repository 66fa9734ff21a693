"""Queries over lead records and pages: scores, keys, detectors, merges, exports; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph import catalog
from lakegraph.functions import columns as C
from lakegraph.functions import leads as L
from lakegraph.functions import records as R
from lakegraph.sources.leads import LEAD_SQL, leads, signals
from lakegraph.sources.tables import Tables

THIS_YEAR = 2001
#: The signals' kinds of the driver's table, under the names that the scores know.
_TYPES = {"purchase": "tender_won", "signup": "hiring", "click": "crm_change", "view": "site_stale", "error": "website_changed"}
_TYPE_SQL = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


def query(name: str, sql: str | None = None):
    return catalog.query(name, LEAD_SQL + sql if sql else None, bound=False)


def signal_type() -> Column:
    return F.create_map(*[F.lit(x) for pair in _TYPES.items() for x in pair])[F.col("kind")]


def lead_types(t: Tables) -> DataFrame:
    """Leads with the set of their signal types."""
    known = signals(t).groupBy("lead").agg(F.collect_set(signal_type()).alias("types"), F.count("*").alias("n_signals"))
    return leads(t).join(known, F.col("id") == F.col("lead"), "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


TYPES_SQL = f", ty AS (SELECT lead, list(DISTINCT {_TYPE_SQL}) AS types, count(*) AS n_signals FROM sig GROUP BY lead), lt AS (SELECT lead.*, coalesce(types, []) AS types, n_signals FROM lead LEFT JOIN ty ON lead = id)"

# Scores

BUYING_SQL = """, f AS (SELECT *, google_ads IS TRUE AS ads, meta_pixel IS TRUE AS px, tag_manager IS TRUE AS tm, analytics IS TRUE AS an, lower(trim(coalesce(phone, ''))) NOT IN ('', 'n/d') OR lower(trim(coalesce(email, ''))) NOT IN ('', 'n/d') AS contact,
    coalesce(forms = 0 AND NOT clickable, false) AS nocap, coalesce(performance < 50, false) AS slow, coalesce(active_ads > 0, false) AS run, coalesce(site, 'N/D') <> 'N/D' AS hassite FROM lead
), g AS (SELECT *, NOT px AND NOT tm AND NOT an AS bare FROM f
), bs AS (SELECT id, CASE WHEN run AND (nocap OR slow OR bare) THEN 52 WHEN run THEN 41 ELSE 0 END + CASE WHEN (px OR ads) AND nocap THEN 51 ELSE 0 END + CASE WHEN slow AND (px OR ads) THEN 50 WHEN slow THEN 38 ELSE 0 END
    + CASE WHEN px AND NOT an AND NOT tm THEN 39 ELSE 0 END + CASE WHEN ads AND bare THEN 51 WHEN ads AND NOT (tm AND an AND px) THEN 50 ELSE 0 END
    + CASE WHEN bare AND vat IS NOT NULL THEN 39 WHEN bare AND (employees >= 6 OR revenue IS NOT NULL) THEN 38 ELSE 0 END
    + CASE WHEN load_seconds >= 4 AND ads THEN 50 WHEN load_seconds >= 4 AND (contact OR rating IS NOT NULL) THEN 38 ELSE 0 END + CASE WHEN rating >= 4.2 AND reviews >= 20 AND bare THEN 39 ELSE 0 END
    + CASE WHEN hassite AND NOT contact THEN 26 ELSE 0 END + CASE WHEN ads AND load_seconds >= 3.2 AND bare THEN 51 ELSE 0 END
    + CASE WHEN coalesce(instagram, 'N/D') = 'N/D' AND coalesce(facebook, 'N/D') = 'N/D' AND rating >= 4 AND reviews >= 15 THEN 27 ELSE 0 END + CASE WHEN ssl = false THEN 39 ELSE 0 END AS total FROM g)"""
_HEAT = "CASE WHEN {0} >= 80 THEN 'caldissimo' WHEN {0} >= 60 THEN 'caldo' WHEN {0} >= 35 THEN 'interessante' ELSE 'freddo' END"


@query("r9_buying_score", BUYING_SQL + f" SELECT id, least(100, total)::BIGINT AS score, {_HEAT.format('total')} AS label FROM bs")
def buying(t: Tables) -> DataFrame:
    score = R.buying_score(R.buying_signals())
    return leads(t).select("id", score.alias("score")).withColumn("label", R.heat_label(F.col("score")))


@query("r10_combined_score", TYPES_SQL + BUYING_SQL + f", c AS (SELECT bs.id, least(100, least(100, total) + least(25, 8 * len(list_filter(types, lambda x: x <> 'site_stale'))) + CASE WHEN list_contains(types, 'tender_won') THEN 12 ELSE 0 END) AS s FROM bs JOIN lt ON lt.id = bs.id) SELECT id, s::BIGINT AS score, {_HEAT.format('s')} AS label FROM c")
def combined(t: Tables) -> DataFrame:
    """Buying score, eight for each business signal up to 25, and twelve for an intent."""
    business = F.size(F.filter("types", lambda x: x != "site_stale"))
    score = C.clamp(R.buying_score(R.buying_signals()) + F.least(F.lit(25), business * 8) + R.points(F.array_contains("types", "tender_won"), 12)).cast("long")
    return lead_types(t).select("id", score.alias("score")).withColumn("label", R.heat_label(F.col("score")))


@query("t4_signal_order", BUYING_SQL.replace("), bs AS", "), bs_unused AS").split(", bs_unused")[0] + """, s AS (SELECT id, 'contact_friction' AS signal, 2 AS r, 68 AS c FROM g WHERE hassite AND NOT contact UNION ALL SELECT id, 'trust_blocker_no_ssl', 1, 84 FROM g WHERE ssl = false
    UNION ALL SELECT id, 'pixel_without_measurement', 1, 84 FROM g WHERE px AND NOT an AND NOT tm UNION ALL SELECT id, 'paid_traffic_landing_leak', 0, 92 FROM g WHERE ads AND load_seconds >= 3.2 AND bare)
  SELECT id, string_agg(signal, ',' ORDER BY r, c DESC, signal) AS ordered FROM s GROUP BY id""")
def signal_order(t: Tables) -> DataFrame:
    """Four of a lead's buying signals by severity, then confidence."""
    some = ["contact_friction", "trust_blocker_no_ssl", "pixel_without_measurement", "paid_traffic_landing_leak"]
    rank = F.create_map(*[F.lit(x) for pair in R.SEVERITY_RANK.items() for x in pair])
    found = F.filter(R.buying_signals(), lambda s: s["id"].isin(some))
    keyed = F.array_sort(F.transform(found, lambda s: F.struct(rank[s["severity"]].alias("r"), (-s["confidence"]).alias("c"), s["id"].alias("id"))))
    return leads(t).select("id", F.array_join(F.transform(keyed, lambda s: s["id"]), ",").alias("ordered")).where("ordered <> ''")


@query("t8_display_order", BUYING_SQL + " SELECT bs.id, least(100, total)::BIGINT AS score FROM bs JOIN lead USING (id) ORDER BY score DESC, lead.score DESC, lower(name), id LIMIT 50")
def display_order(t: Tables) -> DataFrame:
    """The fifty rows shown first: buying score, then opportunity, then name without regard to case."""
    rows = leads(t).select("id", "name", F.col("score").alias("own"), R.buying_score(R.buying_signals()).alias("score"))
    return rows.orderBy(F.desc("score"), F.desc("own"), F.lower("name"), "id").limit(50).select("id", "score")


@query("t3_score_order", "SELECT id, score FROM lead ORDER BY score DESC, id LIMIT 100")
def score_order(t: Tables) -> DataFrame:
    return leads(t).orderBy(F.desc("score"), "id").limit(100).select("id", "score")


_GAPS = "[meta_pixel IS TRUE, tag_manager IS TRUE, google_ads IS TRUE, analytics IS TRUE, ssl IS DISTINCT FROM false, seo_errors IS TRUE, coalesce(load_seconds > 3, false), coalesce(instagram, '') <> '']"
MATURITY_SQL = f""", m AS (SELECT id, category, {_GAPS} AS g FROM lead), mm AS (SELECT id, least(100, 34 + 15 * g[1]::INT + 12 * g[2]::INT + 12 * g[3]::INT + 10 * g[4]::INT + 6 * g[5]::INT + 5 * (NOT g[6])::INT + 3 * (NOT g[7])::INT + 3 * g[8]::INT) AS maturity,
    (NOT (g[1] OR g[2] OR g[3] OR g[4]))::INT AS none, g FROM m), ma AS (SELECT id, maturity::BIGINT AS maturity, CASE WHEN maturity >= 80 THEN 'Avanzato' WHEN maturity >= 55 THEN 'Intermedio' WHEN maturity >= 30 THEN 'Base' ELSE 'Critico' END AS label,
    2 * none + 500 * (NOT g[1])::INT + 300 * (NOT g[2])::INT + 500 * (NOT g[3])::INT + 300 * (NOT g[4])::INT + 100 * (NOT g[5])::INT + 800 * g[6]::INT + 500 * g[7]::INT + 300 * (NOT g[8])::INT + 0.0::DOUBLE AS deal_min,
    5 * none + 2 * (NOT g[1])::INT + 800 * (NOT g[2])::INT + 3 * (NOT g[3])::INT + 600 * (NOT g[4])::INT + 300 * (NOT g[5])::INT + 2.5::DOUBLE * g[6]::INT + 1.5::DOUBLE * g[7]::INT + 1.5::DOUBLE * (NOT g[8])::INT AS deal_max,
    none + (NOT g[4])::INT + (NOT g[5])::INT AS critical, (NOT g[1])::INT + (NOT g[2])::INT + (NOT g[3])::INT + g[6]::INT AS high FROM mm)"""


@query("r13_digital_maturity", MATURITY_SQL + " SELECT id, maturity, label, deal_min, deal_max, CASE WHEN critical >= 2 THEN 'alta' WHEN critical >= 1 OR high >= 2 THEN 'media' ELSE 'bassa' END AS urgency FROM ma")
def maturity(t: Tables) -> DataFrame:
    return leads(t).select("id", *(c.alias(n) for n, c in R.maturity().items()))


_FACTORS = "(CASE WHEN meta_pixel IS NOT TRUE THEN 25 ELSE 0 END + CASE WHEN tag_manager IS NOT TRUE THEN 15 ELSE 0 END + CASE WHEN coalesce(trim(email), '') <> '' THEN 20 ELSE 0 END + CASE WHEN seo_errors THEN 15 ELSE 0 END + CASE WHEN load_seconds > 3 THEN 10 ELSE 0 END + CASE WHEN ssl = false THEN 10 ELSE 0 END + CASE WHEN google_ads IS NOT TRUE THEN 5 ELSE 0 END)"


@query("n23_explanation", f"SELECT id, coalesce(nullif(site, ''), name, 'lead') AS entity_ref, {_FACTORS}::BIGINT AS explained, 7::BIGINT AS factors FROM lead")
def explanation(t: Tables) -> DataFrame:
    """What a lead is called, and the points of the factors that are active."""
    rows = leads(t).select("id", F.coalesce(F.nullif(F.col("site"), F.lit("")), "name", F.lit("lead")).alias("entity_ref"), R.score_factors().alias("f"))
    explained = F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + F.when(x["active"], x["points"]).otherwise(0))
    return rows.select("id", "entity_ref", explained.alias("explained"), F.size("f").cast("long").alias("factors"))


MARKET_SQL = TYPES_SQL + """, mk AS (SELECT id, city, category, greatest(0, least(100, 20 + CASE WHEN google_ads THEN 18 ELSE 0 END + CASE WHEN NOT list_contains(types, 'site_stale') THEN 10 ELSE 0 END + CASE WHEN len(tech_stack) >= 4 THEN 12 WHEN len(tech_stack) >= 2 THEN 6 ELSE 0 END
    + coalesce(least(15, floor(performance / 5.0::DOUBLE + 0.5)), 0) + CASE WHEN site IS NOT NULL THEN 8 ELSE 0 END))::BIGINT AS maturity, (CASE WHEN list_contains(types, 'hiring') THEN 35 ELSE 0 END + CASE WHEN list_contains(types, 'tender_won') THEN 40 ELSE 0 END)::BIGINT AS growth,
    CASE WHEN revenue > 0 THEN revenue WHEN score > 0 THEN least(100, score) * 50000.0::DOUBLE ELSE 300000.0::DOUBLE END AS revenue FROM lt)"""


def market_points(t: Tables) -> DataFrame:
    amount = F.when(F.col("revenue") > 0, F.col("revenue")).when(F.col("score") > 0, F.least(F.lit(100), F.col("score")) * F.lit(50_000.0)).otherwise(300_000.0)
    return lead_types(t).select("id", "city", "category", R.market_maturity(F.col("types")).alias("maturity"), R.growth_rate(F.col("types")).alias("growth"), amount.alias("revenue"))


@query("r14_market_maturity", MARKET_SQL + " SELECT id, maturity, growth, round(revenue, 2) AS revenue FROM mk")
def market(t: Tables) -> DataFrame:
    return market_points(t).select("id", "maturity", "growth", F.round("revenue", 2).alias("revenue"))


@query("n22_market_points", MARKET_SQL + " SELECT id, city, category, maturity, growth, 6 + sqrt(greatest(0, least(1, (revenue - lo) / (hi - lo)))) * 22 AS radius FROM mk, (SELECT greatest(1, min(revenue)) AS lo, greatest(greatest(1, min(revenue)) + 1, max(revenue)) AS hi FROM mk)")
def market_map_points(t: Tables) -> DataFrame:
    rows = market_points(t)
    bounds = rows.agg(F.min("revenue").alias("lo"), F.max("revenue").alias("hi"))  # one row
    return rows.join(F.broadcast(bounds)).select("id", "city", "category", "maturity", "growth", L.revenue_radius(F.col("revenue"), F.col("lo"), F.col("hi")).alias("radius"))


_STRENGTH = "floor(greatest(0, least(100, confidence * greatest(0, (168 - age_hours) / 168.0::DOUBLE) * CASE tier WHEN 'official' THEN 1.0::DOUBLE WHEN 'inferred' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END)) + 0.5)"


@query("r7_intent_breakdown", f"""{TYPES_SQL}, st AS (SELECT lead, avg({_STRENGTH}) AS strength, count(*) FILTER (age_hours < 72) AS recent FROM sig GROUP BY lead),
  b AS (SELECT id, (CASE WHEN list_contains(types, 'hiring') AND list_contains(types, 'crm_change') THEN 35 ELSE 0 END + CASE WHEN list_contains(types, 'tender_won') THEN 25 ELSE 0 END + CASE WHEN list_contains(types, 'hiring') THEN 15 ELSE 0 END
    + CASE WHEN list_contains(types, 'website_changed') THEN 10 ELSE 0 END + CASE WHEN list_contains(types, 'site_stale') THEN 5 ELSE 0 END) AS base, types FROM lt)
  SELECT id, least(100, floor(base * CASE WHEN recent >= 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END * strength / 100 * CASE WHEN list_contains(types, 'hiring') AND list_contains(types, 'tender_won') THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END + 0.5))::BIGINT AS score FROM b JOIN st ON lead = id""")
def intent_breakdown(t: Tables) -> DataFrame:
    """Intent score of leads with signals: rule points, recency, mean strength, and a factor for a related pair."""
    s = signals(t).withColumn("strength", L.signal_strength(F.col("confidence"), F.col("age_hours"), F.col("tier")))
    g = s.groupBy(F.col("lead").alias("id")).agg(F.collect_set(signal_type()).alias("types"), F.avg("strength").alias("strength"), F.count_if(F.col("age_hours") < 72).alias("recent"))
    pair = F.when(F.array_contains("types", "hiring") & F.array_contains("types", "tender_won"), 1.4).otherwise(1.0)  # 1 + 0.5 times a weight of 0.8
    return g.join(leads(t).select("id"), "id", "left_semi").select("id", R.intent_score(F.col("types"), F.col("recent"), F.col("strength"), pair).alias("score"))


QUALITY_SQL = "CASE WHEN pending THEN -200 WHEN len(tech_stack) > 0 THEN 80 ELSE 0 END + CASE WHEN lower(trim(coalesce(email, ''))) NOT IN ('', 'n/d') THEN 25 ELSE 0 END + CASE WHEN len(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')) >= 8 THEN 15 ELSE 0 END + CASE WHEN load_seconds IS NOT NULL THEN 35 ELSE 0 END + CASE WHEN audited_days IS NOT NULL THEN 15 ELSE 0 END"


@query("r16_merge_quality", f"SELECT id, ({QUALITY_SQL})::BIGINT AS merge, (CASE WHEN pending THEN -500 ELSE CASE WHEN len(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g')) >= 8 THEN 100 ELSE 0 END + CASE WHEN contains(coalesce(email, ''), '@') THEN 100 ELSE 0 END + CASE WHEN len(tech_stack) > 0 THEN 80 ELSE 0 END + CASE WHEN load_seconds IS NOT NULL THEN 10 ELSE 0 END + (coalesce(site, 'N/D') <> 'N/D')::INT + (coalesce(instagram, 'N/D') <> 'N/D')::INT + (rating IS NOT NULL)::INT END)::BIGINT AS dedupe FROM lead")
def qualities(t: Tables) -> DataFrame:
    return leads(t).select("id", R.merge_quality().alias("merge"), R.dedupe_quality().alias("dedupe"))


@query("r18_outbound_play", TYPES_SQL + " SELECT id, CASE WHEN score >= 80 THEN 'hot_lead_play' WHEN list_contains(types, 'tender_won') AND score >= 60 THEN 'tender_play' WHEN list_contains(types, 'hiring') AND score >= 50 THEN 'hiring_play' END AS play FROM lt")
def outbound(t: Tables) -> DataFrame:
    return lead_types(t).select("id", R.outbound_play(F.col("types"), F.col("score")).alias("play"))


# Keys and text


@query("f5_linkedin", "SELECT id, CASE WHEN regexp_matches(lower(linkedin), '^https?://[^/]+/(in|company)/') THEN 'linkedin.com' || regexp_replace(regexp_replace(lower(linkedin), '^https?://[^/]+', ''), '/$', '') END AS profile FROM lead")
def profiles(t: Tables) -> DataFrame:
    return leads(t).select("id", R.linkedin(F.col("linkedin")).alias("profile"))


@query("f9_stable_keys", "SELECT id, CASE WHEN site IS NOT NULL AND site <> 'N/D' THEN 'web:' || regexp_extract(site, '//www\\.([^/]*)', 1) WHEN site = 'N/D' THEN 'web:n' WHEN coalesce(phone, 'N/D') <> 'N/D' THEN 'tel:' || right(phone, 9) ELSE 'name:' || lower(regexp_replace(name, '[^A-Za-z0-9]+', '-', 'g')) || ':' || lower(regexp_replace(city, '[^A-Za-z0-9]+', '-', 'g')) END AS key FROM lead")
def stable_keys(t: Tables) -> DataFrame:
    return leads(t).select("id", R.stable_key().alias("key"))


@query("f10_dedupe_keys", """SELECT id, CASE WHEN coalesce(site, 'N/D') <> 'N/D' THEN 'site:' || regexp_replace(site, '^https://www\\.', '') WHEN coalesce(phone, 'N/D') <> 'N/D' THEN 'phone:' || regexp_replace(phone, '[^0-9]', '', 'g') WHEN contains(email, '@') THEN 'email:' || lower(email) ELSE 'name:' || left(lower(name), 40) END AS search_key,
  CASE WHEN site IS NOT NULL THEN 'web:' || CASE WHEN site = 'N/D' THEN 'n' ELSE regexp_extract(site, '//www\\.([^/]*)', 1) END WHEN coalesce(phone, 'N/D') <> 'N/D' THEN 'tel:' || right(phone, 9) ELSE 'name:' || left(lower(name), 40) || ':' || lower(city) END AS graph_key,
  CASE WHEN coalesce(email, '') <> '' THEN 'email:' || lower(email) WHEN coalesce(site, '') <> '' THEN 'site:' || lower(site) ELSE 'name:' || lower(name) END AS crm_key FROM lead""")
def dedupe_keys(t: Tables) -> DataFrame:
    return leads(t).select("id", R.search_key().alias("search_key"), R.graph_key().alias("graph_key"), R.crm_key().alias("crm_key"))


@query("f14_plain_urls", "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '/+$', ''), '^www\\.', '') AS url FROM pages")
def plain_urls(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", R.plain_url(F.col("url")).alias("url"))


@query("f17_crm_stack", "SELECT id, list_filter([CASE WHEN regexp_matches(x, '(?i)\\bhubspot\\b') THEN 'HubSpot' END, CASE WHEN regexp_matches(x, '(?i)\\bsalesforce\\b|force\\.com') THEN 'Salesforce' END, CASE WHEN regexp_matches(x, '(?i)\\bzoho\\b') THEN 'Zoho CRM' END], lambda y: y IS NOT NULL) AS crms FROM (SELECT id, CASE score % 5 WHEN 0 THEN 'uses HubSpot and zoho' WHEN 1 THEN 'https://x.force.com' WHEN 2 THEN 'hubspots' END AS x FROM lead)")
def crm_stacks(t: Tables) -> DataFrame:
    text = F.when(F.col("score") % 5 == 0, "uses HubSpot and zoho").when(F.col("score") % 5 == 1, "https://x.force.com").when(F.col("score") % 5 == 2, "hubspots")
    return leads(t).select("id", R.crm_stack(text).alias("crms"))


@query("f18_reply_intents", "SELECT conv_id, turn, CASE WHEN x = '' THEN NULL WHEN regexp_matches(x, '\\b(unsubscribe|opt.?out|rimuov|gdpr)\\b') THEN 'unsubscribe' WHEN regexp_matches(x, '\\b(wrong person|referente)\\b') THEN 'wrong_person' WHEN regexp_matches(x, '\\b(no grazie|passo|declino)\\b') THEN 'not_interested' WHEN regexp_matches(x, '\\b(call|mandami|inviami)\\b') THEN 'interested' ELSE 'unknown' END AS intent FROM (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'please call me' WHEN 1 THEN 'no grazie, passo' WHEN 2 THEN 'unsubscribe, no call' WHEN 3 THEN 'il referente e un altro' WHEN 4 THEN '' ELSE 'boh' END AS x FROM conversations)")
def reply_intents(t: Tables) -> DataFrame:
    n = F.col("turn") % 6
    said = F.when(n == 0, "please call me").when(n == 1, "no grazie, passo").when(n == 2, "unsubscribe, no call").when(n == 3, "il referente e un altro").when(n == 4, "").otherwise("boh")
    return t.raw("conversations").select("conv_id", "turn", R.reply_intent(said)[0].alias("intent"))


@query("f20_audit_stack", "SELECT id, list_filter([CASE WHEN list_contains(tech_stack, 'wordpress') THEN 'WORDPRESS' WHEN list_contains(tech_stack, 'shopify') THEN 'SHOPIFY' END, CASE WHEN ssl IS DISTINCT FROM false THEN 'SSL' END, CASE WHEN meta_pixel THEN 'Meta Pixel' ELSE 'MISSING FB PIXEL' END, CASE WHEN tag_manager THEN 'GTM' ELSE 'MISSING GTM' END, CASE WHEN google_ads THEN 'GOOGLE ADS' ELSE 'MISSING GOOGLE ADS' END, CASE WHEN load_seconds > 4 THEN 'SITO LENTO' END], lambda x: x IS NOT NULL) AS stack FROM lead")
def audit_stacks(t: Tables) -> DataFrame:
    return leads(t).select("id", R.audit_stack().alias("stack"))


@query("f28_canonical_json", """SELECT id, '{"city":"' || city || '","name":"' || name || '","rating":' || coalesce(CAST(rating AS VARCHAR), 'null') || ',"ssl":' || coalesce(CAST(ssl AS VARCHAR), 'null') || '}' AS json, md5('{"city":"' || city || '","name":"' || name || '","rating":' || coalesce(CAST(rating AS VARCHAR), 'null') || ',"ssl":' || coalesce(CAST(ssl AS VARCHAR), 'null') || '}') AS hash FROM lead""")
def canonical(t: Tables) -> DataFrame:
    json = R.canonical_json({"ssl": F.col("ssl").cast("string"), "name": R.json_string(F.col("name")), "rating": F.col("rating").cast("string"), "city": R.json_string(F.col("city"))})
    return leads(t).select("id", json.alias("json")).withColumn("hash", F.md5("json"))


@query("f30_cache_keys", "SELECT id, 'analytics:' || left(sha256(name), 32) AS key FROM lead")
def cache_keys(t: Tables) -> DataFrame:
    return leads(t).select("id", R.cache_key("analytics", F.col("name")).alias("key"))


@query("f34_json_objects", """SELECT category, '{' || string_agg('"' || city || '":' || n, ',' ORDER BY city) || '}' AS cities FROM (SELECT category, city, count(*) AS n FROM lead GROUP BY ALL) GROUP BY category""")
def json_objects(t: Tables) -> DataFrame:
    """A JSON object of each category: its cities with their counts."""
    g = leads(t).groupBy("category", "city").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("city", "n")))
    return g.groupBy("category").agg(F.to_json(F.map_from_entries(pairs)).alias("cities"))


@query("f35_json_merge", """SELECT id, CASE WHEN score % 2 = 0 THEN '{"a":1,"b":' || score || ',"c":3}' ELSE '{"a":1,"b":2,"c":3}' END AS merged FROM lead""")
def json_merge(t: Tables) -> DataFrame:
    """Two objects, the right one wins; keys in order."""
    left = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    right = F.when(F.col("score") % 2 == 0, F.create_map(F.lit("b"), F.col("score").cast("int"), F.lit("c"), F.lit(3))).otherwise(F.create_map(F.lit("c"), F.lit(3)))
    both = F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
    return leads(t).select("id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both)))).alias("merged"))


@query("f15_page_changes", "WITH_P SELECT page_id, s < 0.88 AS changed, round(s, 4) AS similarity FROM (SELECT page_id, len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / greatest(len(a), len(b), 1) AS s FROM p)".replace("WITH_P", """, p AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(left(html, 4000), '(?i)cookie|gdpr|consent|accetta', ''), '\\s+'), lambda x: x <> '')[:400] AS a,
  list_filter(regexp_split_to_array(regexp_replace(regexp_replace(left(html, 4000), '(?i)cookie|gdpr|consent|accetta', ''), 'th', 'TH'), '\\s+'), lambda x: x <> '')[:400] AS b FROM (SELECT page_id, regexp_replace(regexp_replace(left(html, 4000), '\\b20\\d{2}\\b', 'YYYY', 'g'), '\\b\\d{1,2}[/:-]\\d{1,2}[/:-]\\d{2,4}\\b', 'DATE', 'g') AS html FROM pages))"""))
def page_changes(t: Tables) -> DataFrame:
    """A page against a version of itself in which one word differs."""
    plain = R.plain_diff(F.col("html"))
    rows = t.raw("pages").select("page_id", plain.alias("a")).withColumn("b", F.concat(F.regexp_extract("a", "(?s)^(.*?)th", 1), F.when(F.contains("a", F.lit("th")), F.concat(F.lit("TH"), F.regexp_extract("a", "(?s)^.*?th(.*)$", 1))).otherwise(F.col("a"))))
    rows = rows.select("page_id", C.token_similarity(F.col("a"), F.col("b")).alias("s"))
    return rows.select("page_id", (F.col("s") < 0.88).alias("changed"), F.round("s", 4).alias("similarity"))


# Detectors

_PAGE_SQL = """SELECT page_id, regexp_matches(html, '(?i)<title[^>]*>\\s*[^<\\s]') AS has_title, regexp_matches(html, '(?i)<h1[^>]*>\\s*[^<\\s]') AS has_h1, regexp_matches(html, '(?i)<meta[^>]*name=["'']description["''][^>]*content=["'']\\s*[^"''\\s]') AS has_description,
  regexp_matches(html, '(?i)<meta[^>]*name=["''][^"'']*viewport') AS has_viewport, regexp_matches(html, '(?i)<(?:script|img)[^>]*src=["'']http://|<link[^>]*href=["'']http://') AS mixed_content, regexp_matches(html, '\\bAW-[A-Z0-9]+\\b') AS has_google_ads, regexp_matches(html, '\\bG-[A-Z0-9]+\\b') AS has_ga4,
  regexp_matches(lower(html), 'tidio\\.co|tidiochat|intercom\\.io|intercomcdn\\.com|widget\\.intercom|crisp\\.|tawk\\.to|zendesk|zopim|livechatinc|smartsupp|chatbase|botpress') AS has_chatbot, regexp_matches(lower(html), 'calendly\\.com|treatwell|thefork|fork-cdn|youcanbook') AS has_booking, regexp_matches(lower(html), 'shopify|woocommerce|magento') AS has_shop,
  contains(lower(html), 'instagram.com') AS has_instagram, contains(lower(html), 'googletagmanager.com') AS has_gtm, coalesce(nullif(regexp_extract(html, '(?i)mailto:([A-Z0-9._%+\\-]+@[A-Z0-9.\\-]+\\.[A-Z]{2,})', 1), ''), upper(nullif(
    CASE WHEN contains(lower(html), 'p.iva') THEN 'p.iva' WHEN contains(lower(html), 'partita iva') THEN 'partita iva' WHEN contains(lower(html), 'titolare') THEN 'titolare' WHEN contains(lower(html), 'dott.') THEN 'dott.' WHEN contains(lower(html), 'avv.') THEN 'avv.' WHEN contains(lower(html), 'amministratore') THEN 'amministratore' WHEN contains(lower(html), 'ceo') THEN 'ceo' WHEN contains(lower(html), 'founder') THEN 'founder' END, '')), 'N/D') AS decision_maker,
  NOT (regexp_matches(html, '(?i)<title[^>]*>\\s*[^<\\s]') AND regexp_matches(html, '(?i)<h1[^>]*>\\s*[^<\\s]')) AS seo_disaster FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)"""


@query("d1_page_audit", _PAGE_SQL)
def page_audit(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", *(c.alias(n) for n, c in R.page_audit(F.col("html")).items()))


STALE_SQL = f""", ss AS (SELECT id, 'site_stale_copyright' AS signal, CASE WHEN copyright_year <= {THIS_YEAR - 4} THEN 'high' ELSE 'medium' END AS severity, 82 AS confidence FROM lead WHERE coalesce(site, 'N/D') <> 'N/D' AND copyright_year <= {THIS_YEAR - 2}
  UNION ALL SELECT id, 'site_stale_slow', CASE WHEN load_seconds >= 6 THEN 'high' ELSE 'medium' END, 78 FROM lead WHERE coalesce(site, 'N/D') <> 'N/D' AND load_seconds >= 4.5
  UNION ALL SELECT id, 'site_stale_audit_age', CASE WHEN fr <= 10 THEN 'high' ELSE 'medium' END, 70 FROM (SELECT *, floor(greatest(0, 100 - audited_days / 30.0::DOUBLE * 100) + 0.5) AS fr FROM lead) WHERE coalesce(site, 'N/D') <> 'N/D' AND fr > 0 AND fr <= 25)"""


def stale(t: Tables) -> DataFrame:
    return leads(t).select("id", F.explode(R.stale_signals(THIS_YEAR)).alias("s")).select("id", F.col("s.id").alias("signal"), "s.severity", "s.confidence")


@query("d2_site_stale", STALE_SQL + " SELECT id, signal, severity, confidence::BIGINT AS confidence FROM ss")
def site_stale(t: Tables) -> DataFrame:
    return stale(t)


@query("d3_tender_window", f", th AS (SELECT lead, id, seen_at FROM sig WHERE kind = 'purchase' AND seen_at >= TIMESTAMP '2024-01-10') SELECT lead, arg_min(id, (seen_at, id)) AS first_hit, least(3, count(*)) AS evidence FROM th GROUP BY lead")
def tender_window(t: Tables) -> DataFrame:
    """Leads with a tender since a date: the first hit, and how many of three are shown."""
    hits = signals(t).where("kind = 'purchase'").where(F.col("seen_at") >= F.lit("2024-01-10").cast("timestamp"))
    return hits.groupBy("lead").agg(F.min_by("id", F.struct("seen_at", "id")).alias("first_hit"), F.least(F.lit(3), F.count("*")).alias("evidence"))


_SECTOR_WORDS = ["build", "furn", "house"]


@query("d4_sector_keywords", "SELECT id, list_filter(['build', 'furn', 'house'], lambda w: contains(lower(category), w) OR contains(lower(name), w)) AS matched FROM lead WHERE len(list_filter(['build', 'furn', 'house'], lambda w: contains(lower(category), w) OR contains(lower(name), w))) > 0")
def sector_keywords(t: Tables) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "category", "name"))
    matched = F.filter(F.array(*map(F.lit, _SECTOR_WORDS)), lambda w: F.contains(text, w))
    return leads(t).select("id", matched.alias("matched")).where(F.size("matched") > 0)


@query("d5_signal_union", STALE_SQL + f", hi AS (SELECT id, 'hiring_organic_growth' AS signal, CASE WHEN employees >= 50 THEN 'high' ELSE 'medium' END AS severity, 74 AS confidence FROM lead WHERE employees >= 15 AND id NOT IN (SELECT lead FROM sig WHERE kind = 'signup')), wo AS (SELECT DISTINCT lead, 'worker_' || {_TYPE_SQL}, 'high', 90 FROM sig WHERE kind IN ('signup', 'purchase')) SELECT id, signal, severity, confidence::BIGINT AS confidence FROM (SELECT * FROM ss UNION ALL SELECT * FROM hi UNION ALL SELECT * FROM wo)")
def signal_union(t: Tables) -> DataFrame:
    """Signals that the worker stored, and those that rules find; a stored hiring signal stands for the rule's."""
    stored = signals(t).where(F.col("kind").isin("signup", "purchase")).select(F.col("lead").alias("id"), F.concat(F.lit("worker_"), signal_type()).alias("signal"), F.lit("high").alias("severity"), F.lit(90).cast("long").alias("confidence")).distinct()
    hired = signals(t).where("kind = 'signup'").select(F.col("lead").alias("id"))
    grown = leads(t).where("employees >= 15").join(hired, "id", "left_anti")
    rule = grown.select("id", F.lit("hiring_organic_growth").alias("signal"), F.when(F.col("employees") >= 50, "high").otherwise("medium").alias("severity"), F.lit(74).cast("long").alias("confidence"))
    return stale(t).unionByName(rule).unionByName(stored)


@query("n16_hiring_signals", "SELECT id, 'hiring_organic_growth' AS signal, CASE WHEN employees >= 50 THEN 'high' ELSE 'medium' END AS severity FROM lead WHERE employees >= 15")
def hiring_signals(t: Tables) -> DataFrame:
    return leads(t).where("employees >= 15").select("id", F.lit("hiring_organic_growth").alias("signal"), F.when(F.col("employees") >= 50, "high").otherwise("medium").alias("severity"))


@query("n43_ad_spend_signals", "SELECT id, 'Investe in Meta Advertising — ' || active_ads || ' inserzioni attive' AS title, 94::BIGINT AS confidence FROM lead WHERE active_ads > 0 AND score % 2 = 0")
def ad_spend(t: Tables) -> DataFrame:
    """Verified running advertisements (here: of even scores)."""
    title = F.concat(F.lit("Investe in Meta Advertising — "), F.col("active_ads").cast("string"), F.lit(" inserzioni attive"))
    return leads(t).where("active_ads > 0 and score % 2 = 0").select("id", title.alias("title"), F.lit(94).cast("long").alias("confidence"))


@query("n19_signal_counts", TYPES_SQL + " SELECT id, coalesce(n_signals, (len(tech_stack) > 0)::INT + (active_ads > 0)::INT, (len(tech_stack) > 0)::INT)::BIGINT AS n FROM lt")
def signal_counts(t: Tables) -> DataFrame:
    """The stored signals, else one for each kind of evidence that a lead has."""
    evidence = (F.size("tech_stack") > 0).cast("int") + F.coalesce((F.col("active_ads") > 0).cast("int"), F.lit(0))
    return lead_types(t).select("id", F.coalesce("n_signals", evidence).cast("long").alias("n"))


@query("m4_signal_events", """, ty AS (SELECT id, unnest(list_filter([CASE WHEN employees >= 100 THEN 'hiring' END, CASE WHEN google_ads THEN 'google_ads_started' END, CASE WHEN meta_pixel THEN 'META_ads_started' END, CASE WHEN revenue > 5000000 THEN 'tender_won' END, CASE WHEN active_ads > 4 THEN 'expansion' END, CASE WHEN pending THEN 'nothing' END], lambda x: x IS NOT NULL)) AS s FROM lead)
 SELECT id, s AS signal_type, CASE s WHEN 'hiring' THEN 'new_hiring' WHEN 'google_ads_started' THEN 'ads_started' WHEN 'META_ads_started' THEN 'pixel_installed' WHEN 'tender_won' THEN 'tender_won' WHEN 'expansion' THEN 'registry_change' END AS event_type,
 CASE s WHEN 'hiring' THEN 'new_hiring' WHEN 'google_ads_started' THEN 'crm_installed' WHEN 'META_ads_started' THEN 'pixel_installed' END AS worker_event_type FROM ty""")
def signal_events(t: Tables) -> DataFrame:
    """The signals that each lead's fields give, and the event type of each by both maps."""
    tests = {"hiring": "employees >= 100", "google_ads_started": "google_ads", "META_ads_started": "meta_pixel", "tender_won": "revenue > 5000000", "expansion": "active_ads > 4", "nothing": "pending"}
    rows = leads(t).select("id", F.explode(F.array_compact(F.array(*[F.when(F.expr(test), kind) for kind, test in tests.items()]))).alias("signal_type"))
    return rows.select("id", "signal_type", R.event_of_signal(F.col("signal_type")).alias("event_type"), R.event_of_signal(F.col("signal_type"), worker=True).alias("worker_event_type"))


# Filters

_SITE = "coalesce(site, 'N/D') <> 'N/D'"


@query("p19_any_of_sixteen", f"""SELECT id FROM lead WHERE {_SITE} AND (seo_errors IS TRUE OR meta_pixel IS NOT TRUE OR tag_manager IS NOT TRUE OR ssl = false OR google_ads IS NOT TRUE OR coalesce(instagram, 'N/D') = 'N/D' OR analytics IS NOT TRUE OR load_seconds > 3 OR coalesce(facebook, 'N/D') = 'N/D'
  OR dmarc IS NOT TRUE OR mobile IS NOT TRUE OR coalesce(linkedin, 'N/D') = 'N/D' OR coalesce(email, 'N/D') = 'N/D' OR (rating > 0 AND rating < 4) OR reviews < 10)""")
def any_of_sixteen(t: Tables) -> DataFrame:
    return leads(t).where(L.any_gap(list(L.GAP_TESTS))).select("id")


@query("p19_slow_or_low_rating", f"SELECT id FROM lead WHERE {_SITE} AND (load_seconds > 3 OR (rating > 0 AND rating < 4))")
def slow_or_low(t: Tables) -> DataFrame:
    return leads(t).where(L.any_gap(["slow_site", "low_rating"])).select("id")


@query("p19_no_site_or_social", "SELECT id FROM lead WHERE coalesce(site, 'N/D') = 'N/D' OR coalesce(linkedin, 'N/D') = 'N/D'")
def no_site_or_social(t: Tables) -> DataFrame:
    return leads(t).where(L.any_gap(["no_site", "no_linkedin"])).select("id")


@query("p20_requirements", "SELECT id FROM lead WHERE id IN (SELECT lead FROM sig WHERE kind = 'purchase') AND id IN (SELECT lead FROM sig WHERE kind = 'signup' AND confidence >= 30) AND id IN (SELECT lead FROM sig WHERE kind = 'click' AND age_hours <= 120)")
def requirements(t: Tables) -> DataFrame:
    """All requirements of a list of (kind, least confidence, greatest age in hours)."""
    return L.meeting(leads(t), signals(t), [("purchase", None, None), ("signup", 30, None), ("click", None, 120)]).select("id")


@query("p21_business_filter", "SELECT id FROM lead WHERE id IN (SELECT lead FROM sig WHERE kind = 'purchase' AND confidence >= 95)")
def business_filter(t: Tables) -> DataFrame:
    hits = signals(t).where("kind = 'purchase' and confidence >= 95").select(F.col("lead").alias("id"))
    return L.hits_or_all(leads(t), hits).select("id")


@query("p23_category_relevance", "SELECT id FROM lead WHERE NOT (contains(lower(category), 'auto') OR contains(lower(name || ' ' || category), 'machin'))")
def category_relevance(t: Tables) -> DataFrame:
    """Leads whose text shows no word of a conflicting trade."""
    return leads(t).where(L.relevant(["auto", "machin"])).select("id")


@query("p25_agency_exclusion", "SELECT id FROM (SELECT id, name || CASE score % 4 WHEN 0 THEN ' Digital Marketing' WHEN 1 THEN ' Web Agency' WHEN 2 THEN ' agenzia di comunicazione' ELSE ' Market' END AS name FROM lead) WHERE NOT regexp_matches(lower(name), '\\bagenzia\\b.*\\b(marketing|comunicaz|digital|web)|\\bdigital\\s+marketing\\b|\\bweb\\s+agenc|\\bagency\\b')")
def agency_exclusion(t: Tables) -> DataFrame:
    n = F.col("score") % 4
    name = F.concat("name", F.when(n == 0, " Digital Marketing").when(n == 1, " Web Agency").when(n == 2, " agenzia di comunicazione").otherwise(" Market"))
    return leads(t).withColumn("name", name).where(~L.is_agency(F.col("name"), F.col("category"))).select("id")


@query("p12_city_substring", "SELECT id FROM lead WHERE contains(lower(city), 'nation_1')")
def city_substring(t: Tables) -> DataFrame:
    return leads(t).where(C.contains_ci(F.col("city"), "Nation_1")).select("id")


@query("n40_admission", "SELECT id FROM lead WHERE (coalesce(phone, 'N/D') <> 'N/D' AND len(regexp_replace(phone, '[^0-9]', '', 'g')) >= 8) OR (contains(email, '@') AND split_part(email, '@', 2) <> 'example.com') OR (coalesce(site, 'N/D') <> 'N/D' AND NOT pending AND len(tech_stack) > 0)")
def admission(t: Tables) -> DataFrame:
    """A phone of eight digits, a real mail address, or a site with an audited stack."""
    phone = L.present(F.col("phone")) & (F.length(F.regexp_replace("phone", "[^0-9]", "")) >= 8)
    audited = L.present(F.col("site")) & ~F.col("pending") & (F.size("tech_stack") > 0)
    return leads(t).where(phone | L.has_contact(F.lit(None).cast("string"), F.col("email")) | audited).select("id")


@query("n28_resume_audits", "SELECT id, pending OR len(tech_stack) = 0 AND load_seconds IS NULL AS pending, (pending OR len(tech_stack) = 0 AND load_seconds IS NULL) AND coalesce(site, 'N/D') <> 'N/D' AS resume FROM lead")
def resume_audits(t: Tables) -> DataFrame:
    waits = F.col("pending") | ((F.size("tech_stack") == 0) & F.col("load_seconds").isNull())
    return leads(t).select("id", waits.alias("pending"), (waits & L.present(F.col("site"))).alias("resume"))


@query("e14_exhausted_scrapes", "SELECT id, CASE WHEN category = 'BUILDING' THEN score < 50 ELSE (reviews % 7 >= 3 AND score > 0) OR reviews % 7 >= 6 END AS exhausted FROM lead")
def exhausted(t: Tables) -> DataFrame:
    status = F.when(F.col("category") == "BUILDING", "completed").otherwise("running")
    return leads(t).select("id", R.scrape_exhausted(status, F.col("score"), F.lit(50), F.col("reviews") % 7, F.col("score")).alias("exhausted"))


@query("n12_token_search", "SELECT id FROM lead WHERE (contains(lower(name || ' ' || category), 'build') OR contains(lower(name || ' ' || category), '#0000000')) AND contains(lower(city), 'nation_1') AND meta_pixel IS NOT TRUE AND coalesce(instagram, '') = ''")
def token_search(t: Tables) -> DataFrame:
    """Any token in name and category, then place and what must be missing."""
    text = F.lower(F.concat_ws(" ", "name", "category"))
    fit = R.any_of(text, ["build", "#0000000"]) & C.contains_ci(F.col("city"), "nation_1")
    return leads(t).where(fit & ~L.is_true(F.col("meta_pixel")) & (F.coalesce(F.trim("instagram"), F.lit("")) == "")).select("id")


@query("n11_role_match", "SELECT id FROM (SELECT id, CASE score % 5 WHEN 0 THEN 'Senior CMO' WHEN 1 THEN 'Head of communication' WHEN 2 THEN 'venditori esterni' WHEN 3 THEN 'cmos' ELSE 'marketing manager' END AS job FROM lead) WHERE regexp_matches(lower(job), '\\bcmo\\b|\\bcommerciale\\b|\\bcommercial\\b|\\bsales\\b|\\bvenditor\\w*\\b|\\baccount manager\\b|marketing manager')")
def role_match(t: Tables) -> DataFrame:
    """Roles of up to four letters as whole words, sales roles by their own words, others as substrings."""
    n = F.col("score") % 5
    job = F.when(n == 0, "Senior CMO").when(n == 1, "Head of communication").when(n == 2, "venditori esterni").when(n == 3, "cmos").otherwise("marketing manager")
    return leads(t).where(L.role_match(job, ["cmo", "commerciale", "marketing manager"])).select("id")


_SUBTYPE = (["industrial", "cold room"], ["domestic", "fridge repair"])


@query("n13_subtype", "SELECT page_id, CASE WHEN regexp_matches(x, '\\b(industrial|cold room)\\b') THEN 'match' WHEN regexp_matches(x, '\\b(domestic|fridge repair)\\b') THEN 'opposite' ELSE 'unknown' END AS verdict FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'industrial and domestic' WHEN 1 THEN 'fridge repair' WHEN 2 THEN 'domestics' ELSE '' END AS x FROM pages)")
def subtype(t: Tables) -> DataFrame:
    n = F.col("page_id") % 4
    text = F.when(n == 0, "industrial and domestic").when(n == 1, "fridge repair").when(n == 2, "domestics").otherwise("")
    return t.raw("pages").select("page_id", L.subtype(text, *_SUBTYPE).alias("verdict"))


@query("n33_category_variants", "SELECT id, category FROM lead WHERE regexp_matches(lower(category), '^(automobil[aeio]?|household[s]?)$') OR lower(category) IN ('automobile', 'household')")
def category_variants(t: Tables) -> DataFrame:
    return leads(t).where(L.strict_category(F.col("category"), ["automobile", "household"])).select("id", "category")


@query("n41_vertical_evidence", "SELECT id FROM lead WHERE regexp_matches(lower(category || ' ' || name), 'build|machin') AND NOT regexp_matches(lower(category || ' ' || name), '#00000001\\d') AND site IS NOT NULL")
def vertical_evidence(t: Tables) -> DataFrame:
    """Rows with a required word and without a forbidden one, that have a site."""
    text = F.lower(F.concat_ws(" ", "category", "name"))
    return leads(t).where(R.any_of(text, ["build", "machin"]) & ~text.rlike(r"#00000001\d") & F.col("site").isNotNull()).select("id")


# People

PEOPLE_SQL = """, ap AS (SELECT CASE WHEN contains(email, '@') THEN lower(email) ELSE lower(name) END AS key, name, CASE WHEN score % 3 = 0 THEN phone END AS phone, CASE score % 4 WHEN 0 THEN 'Founder' WHEN 1 THEN 'Avvocato' WHEN 2 THEN 'Clerk' END AS title, employees AS size FROM lead WHERE score < 60),
  bp AS (SELECT CASE WHEN contains(email, '@') THEN lower(email) ELSE lower(name) END AS key, name, phone, CASE score % 3 WHEN 0 THEN 'CEO' END AS title, employees AS size, CASE score % 2 WHEN 0 THEN 'manager' END AS seniority FROM lead WHERE score >= 40),
  a1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY name) AS r FROM ap) WHERE r = 1), b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY name) AS r FROM bp) WHERE r = 1),
  pe AS (SELECT coalesce(a.key, b.key) AS key, coalesce(a.name, b.name) AS name, coalesce(a.phone, b.phone) AS phone, coalesce(a.title, b.title) AS title, seniority, coalesce(a.size, b.size) AS size, (a.key IS NOT NULL)::INT + (b.key IS NOT NULL)::INT AS sources FROM a1 a FULL JOIN b1 b ON a.key = b.key),
  pk AS (SELECT *, CASE WHEN title IS NULL AND seniority IS NULL THEN NULL WHEN title IN ('Founder', 'CEO') THEN 'Imprenditore' WHEN title = 'Avvocato' THEN 'Libero Professionista / P.IVA' WHEN seniority = 'manager' THEN 'Dirigente / Manager' ELSE 'Dipendente' END AS kind FROM pe)"""


def people(t: Tables) -> DataFrame:
    """Persons of two sources by mail address, else name: the first fills, the second adds what is missing."""
    key = F.when(F.contains("email", F.lit("@")), F.lower("email")).otherwise(F.lower("name"))
    n = F.col("score")
    first = leads(t).where("score < 60").select(key.alias("key"), "name", F.when(n % 3 == 0, F.col("phone")).alias("phone"), F.when(n % 4 == 0, "Founder").when(n % 4 == 1, "Avvocato").when(n % 4 == 2, "Clerk").alias("title"), F.col("employees").alias("size"))
    second = leads(t).where("score >= 40").select(key.alias("key"), "name", "phone", F.when(n % 3 == 0, "CEO").alias("title"), F.col("employees").alias("size"), F.when(n % 2 == 0, "manager").alias("seniority"))
    return L.merge_people(first, second)


@query("n14_person_merge", PEOPLE_SQL + " SELECT key, name, phone, title, seniority, sources FROM pk")
def person_merge(t: Tables) -> DataFrame:
    return people(t).select("key", "name", "phone", "title", "seniority", "sources")


@query("n15_person_class", PEOPLE_SQL + " SELECT key, kind, CASE WHEN kind = 'Imprenditore' AND size > 20 THEN '5.000 - 15.000 €/anno' WHEN kind = 'Imprenditore' AND size > 5 THEN '2.500 - 8.000 €/anno' WHEN kind = 'Imprenditore' THEN '1.500 - 4.000 €/anno' WHEN kind LIKE 'Libero%' THEN '1.000 - 3.000 €/anno' WHEN size > 50 THEN '10.000+ €/anno' ELSE '500 - 2.000 €/anno' END AS potential FROM pk")
def person_class(t: Tables) -> DataFrame:
    kind = R.employment(F.col("title"), F.col("seniority"))
    return people(t).select("key", kind.alias("kind"), R.potential(kind, F.coalesce("size", F.lit(0))).alias("potential"))


# Merges, exports and sinks


@query("s6_hot_columns", "SELECT id, coalesce(nullif(CASE WHEN score % 3 = 0 THEN name WHEN score % 3 = 1 THEN '' END, ''), 'payload ' || id) AS azienda, coalesce(nullif(city, ''), 'none') AS citta, coalesce(rating, 1.5) AS rating FROM lead")
def hot_columns(t: Tables) -> DataFrame:
    """Typed columns that aren't empty overlay the payload."""
    payload = F.from_json(F.to_json(F.struct(F.concat(F.lit("payload "), "id").alias("azienda"), F.lit("none").alias("citta"), F.lit(1.5).alias("rating"))), "azienda string, citta string, rating double")
    name = F.when(F.col("score") % 3 == 0, F.col("name")).when(F.col("score") % 3 == 1, "")
    rows = leads(t).select("id", name.alias("azienda"), F.col("city").alias("citta"), "rating", payload.alias("payload"))
    return L.overlay(rows, "payload", ["azienda", "citta", "rating"]).select("id", "azienda", "citta", "rating")


@query("s11_csv_lines", """SELECT id, '"' || replace(name, '"', '""') || '","' || replace(city, '"', '""') || '","' || category || '","' || coalesce(site, '') || '","' || coalesce(phone, '') || '","' || coalesce(email, '') || '","' || score || '","' || id || '"' AS line FROM lead""")
def csv_lines(t: Tables) -> DataFrame:
    """The lines of the eight-column export: every field quoted, quotes doubled."""
    return leads(t).select("id", L.csv_line(["name", "city", "category", "site", "phone", "email", "score", "id"]).alias("line"))


@query("n29_crm_payload", "SELECT id, name AS company, coalesce(trim(site), '') AS website, coalesce(trim(phone), '') AS phone, city, CASE WHEN score >= 80 THEN 'OPEN' ELSE 'NEW' END AS status, 'Intent ' || score || '/100' AS description FROM lead")
def crm_payload(t: Tables) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return leads(t).select("id", F.col("name").alias("company"), blank("site").alias("website"), blank("phone").alias("phone"), "city", F.when(F.col("score") >= 80, "OPEN").otherwise("NEW").alias("status"), F.concat(F.lit("Intent "), F.col("score").cast("string"), F.lit("/100")).alias("description"))


@query("u4_quality_merge", f""", kv AS (SELECT *, 'tel:' || regexp_replace(phone, '[^0-9]', '', 'g') AS key, {QUALITY_SQL} AS q FROM lead WHERE coalesce(phone, 'N/D') <> 'N/D') SELECT key, arg_max(id, (NOT pending, q, id)) AS id, coalesce(arg_max(nullif(email, ''), (NOT pending, q, id)) FILTER (email IS NOT NULL AND email <> ''), NULL) AS email, count(*) AS merged FROM kv GROUP BY key""")
def quality_merge(t: Tables) -> DataFrame:
    """Rows of one phone become the best of them; its blank mail address comes from the next best that has one."""
    rows = leads(t).where(L.present(F.col("phone"))).withColumn("key", F.concat(F.lit("tel:"), F.regexp_replace("phone", "[^0-9]", "")))
    best = F.struct(~F.col("pending"), R.merge_quality(), "id")
    mail = F.nullif(F.col("email"), F.lit(""))
    return rows.groupBy("key").agg(F.max_by("id", best).alias("id"), F.max_by(mail, F.when(mail.isNotNull(), best)).alias("email"), F.count("*").alias("merged"))


@query("u8_signal_dedupe", "SELECT lead, kind, tier, min(id) AS id FROM sig GROUP BY ALL")
def signal_dedupe(t: Tables) -> DataFrame:
    """A lead's signals of one type and title (here: tier) count once; the first stays."""
    return signals(t).groupBy("lead", "kind", "tier").agg(F.min("id").alias("id"))


@query("u9_paging_dedupe", "SELECT key, id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n) AS r FROM (SELECT id, CAST(substr(id, 3) AS BIGINT) AS n, lower(trim(coalesce(nullif(site, ''), name))) AS key FROM lead)) WHERE r = 1")
def paging_dedupe(t: Tables) -> DataFrame:
    """One row for each first identity that isn't empty; the first row stays."""
    key = F.lower(F.trim(F.coalesce(F.nullif(F.col("site"), F.lit("")), "name")))
    return leads(t).groupBy(key.alias("key")).agg(F.min_by("id", F.substring("id", 3, 20).cast("long")).alias("id"))


@query("n35_fan_out", "SELECT key, min(id) AS id FROM (SELECT id, coalesce(nullif(site, 'N/D'), name) AS key FROM lead WHERE category IN ('BUILDING', 'MACHINERY')) GROUP BY key")
def fan_out_search(t: Tables) -> DataFrame:
    """A search for each sub-category, united; one row for each site, else name."""
    parts = [leads(t).where(F.col("category") == c).select("id", F.coalesce(F.nullif(F.col("site"), F.lit("N/D")), "name").alias("key")) for c in ("BUILDING", "MACHINERY")]
    return parts[0].unionByName(parts[1]).groupBy("key").agg(F.min("id").alias("id"))


@query("n36_bulk_save", "SELECT host, min(id) AS id FROM (SELECT id, regexp_extract(site, '//www\\.([^/]*)', 1) AS host FROM lead WHERE coalesce(site, 'N/D') <> 'N/D' AND score >= 50) WHERE host NOT IN (SELECT regexp_extract(site, '//www\\.([^/]*)', 1) FROM lead WHERE coalesce(site, 'N/D') <> 'N/D' AND score < 20) GROUP BY host")
def bulk_save(t: Tables) -> DataFrame:
    """New rows, one for each site, whose site no stored row has."""
    rows = leads(t).where(L.present(F.col("site"))).select("id", "score", C.normalize_domain(F.col("site")).alias("host"))
    return L.new_only(rows.where("score >= 50"), rows.where("score < 20"), "host", "id")


@query("e12_waterfall", "SELECT lead, arg_min(kind, (CASE tier WHEN 'official' THEN 0 WHEN 'aggregator' THEN 1 WHEN 'inferred' THEN 2 ELSE 3 END, id)) AS kind FROM sig WHERE confidence >= 40 GROUP BY lead")
def waterfall(t: Tables) -> DataFrame:
    """The first source, by tier, that has an answer for a lead."""
    tier = F.when(F.col("tier") == "official", 0).when(F.col("tier") == "aggregator", 1).when(F.col("tier") == "inferred", 2).otherwise(3)
    return signals(t).where("confidence >= 40").groupBy("lead").agg(F.min_by("kind", F.struct(tier, "id")).alias("kind"))


@query("n25_search_hits", "SELECT DISTINCT page_id, 'example' AS company FROM pages WHERE contains(lower(url), 'example') AND contains(lower(url || ' ' || coalesce(html, '')), 'example')")
def search_hits(t: Tables) -> DataFrame:
    """Search results that name a company: its domain, or two of its tokens; each once."""
    blob = F.lower(F.concat_ws(" ", "url", "html"))
    return t.raw("pages").where(L.names_company(blob, ["example", "group"], "example.com")).select("page_id", F.lit("example").alias("company")).distinct()


@query("n21_signal_validation", "SELECT sig.id FROM sig JOIN lead ON lead.id = lead WHERE tier = 'official' OR (kind = 'signup' AND vat IS NOT NULL) OR contains(lower('evidence for ' || CASE WHEN sig.id % 2 = 0 THEN name ELSE 'another' END), lower(name))")
def signal_validation(t: Tables) -> DataFrame:
    """Signals of trusted sources, registry changes with a VAT number, or evidence that has the lead's name."""
    blob = F.concat(F.lit("evidence for "), F.when(F.col("sid") % 2 == 0, F.col("name")).otherwise("another"))
    rows = signals(t).select(F.col("id").alias("sid"), F.col("lead").alias("id"), "kind", "tier").join(leads(t).select("id", "name", "vat"), "id")
    fits = (F.col("tier") == "official") | ((F.col("kind") == "signup") & F.col("vat").isNotNull()) | F.contains(F.lower(blob), F.lower("name"))
    return rows.where(fits).select(F.col("sid").alias("id"))
