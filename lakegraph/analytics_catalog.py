"""Queries of the analytics, lifecycle and event-stream operators in full; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph import catalog
from lakegraph.functions import columns as C
from lakegraph.functions import leads as L
from lakegraph.functions import records as R
from lakegraph.operators import analytics as A
from lakegraph.operators import graph
from lakegraph.operators import lifecycle as Y
from lakegraph.operators import matching as M
from lakegraph.plans.query import Observation, Query, Relationship, execute
from lakegraph.sources import sinks
from lakegraph.sources.leads import LEAD_SQL, leads, signals
from lakegraph.sources.tables import BINDING_SQL, Tables
from lakegraph.streaming import events as S


def query(name: str, sql: str | None = None, bound: str = "lead"):
    prefix = {"lead": LEAD_SQL, "graph": BINDING_SQL, "none": ""}[bound]
    return catalog.query(name, prefix + sql if sql else None, bound=False)


# Deals and outreach. Outreach is bound to the driver's events.

DEALS_SQL = """, ou AS (SELECT event_id AS id, 'c:' || user_id AS lead, CASE event_id % 3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'email' ELSE 'phone' END AS channel, CASE event_id % 5 WHEN 0 THEN 'interested' WHEN 1 THEN 'replied' ELSE 'sent' END AS status, 9000 + (event_id * 37) % 2500 AS day FROM events),
 de AS (SELECT o_orderkey AS id, 'c:' || o_custkey AS lead, CASE o_orderstatus WHEN 'F' THEN 'vinto' WHEN 'P' THEN 'perso' ELSE CASE o_orderkey % 4 WHEN 0 THEN 'nuovo' WHEN 1 THEN 'contattato' WHEN 2 THEN 'meeting' ELSE 'proposta' END END AS stage, o_totalprice AS deal_value, o_orderkey % 101 AS score,
   date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders)"""


def outreach(t: Tables) -> DataFrame:
    n = F.col("event_id")
    channel = F.when(n % 3 == 0, "whatsapp").when(n % 3 == 1, "email").otherwise("phone")
    status = F.when(n % 5 == 0, "interested").when(n % 5 == 1, "replied").otherwise("sent")
    return t.raw("events").select(n.alias("id"), F.concat(F.lit("c:"), "user_id").alias("lead"), channel.alias("channel"), status.alias("status"), (n * 37 % 2500 + 9000).alias("day"))


def deals(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    open_ = F.when(k % 4 == 0, "nuovo").when(k % 4 == 1, "contattato").when(k % 4 == 2, "meeting").otherwise("proposta")
    stage = F.when(F.col("o_orderstatus") == "F", "vinto").when(F.col("o_orderstatus") == "P", "perso").otherwise(open_)
    return t.raw("orders").select(k.alias("id"), F.concat(F.lit("c:"), "o_custkey").alias("lead"), stage.alias("stage"), F.col("o_totalprice").alias("deal_value"), (k % 101).alias("score"), F.unix_date(F.to_date("o_orderdate")).cast("long").alias("day"))


CLOSURE_SQL = DEALS_SQL + """, ot AS (SELECT lead, bool_or(status = 'interested') AS interested, bool_or(channel = 'whatsapp') AS whatsapp, bool_or(channel = 'email') AS email, min(day) AS first_day FROM ou GROUP BY lead),
 cl AS (SELECT de.*, stage = 'vinto' AS w, interested, whatsapp, email, first_day FROM de LEFT JOIN ot USING (lead) WHERE stage IN ('vinto', 'perso')), base AS (SELECT floor(100.0::DOUBLE * count(*) FILTER (w) / count(*) + 0.5) AS b, count(*) AS n FROM cl),
 sg AS (SELECT w, unnest(list_filter([CASE WHEN score >= 70 THEN 'score_hot' END, CASE WHEN score >= 50 AND score < 70 THEN 'score_warm' END, CASE WHEN interested THEN 'outreach_interested' END, CASE WHEN whatsapp THEN 'channel_whatsapp' END, CASE WHEN email THEN 'channel_email' END, CASE WHEN day - first_day <= 14 THEN 'fast_close' END], lambda x: x IS NOT NULL)) AS signal FROM cl),
 cp AS (SELECT signal, won, lost, baseline, segment, segment - baseline AS lift, least(0.95::DOUBLE, 0.45::DOUBLE + (won + lost) * 0.08::DOUBLE) AS confidence FROM (SELECT signal, count(*) FILTER (w) AS won, count(*) FILTER (NOT w) AS lost, floor(100.0::DOUBLE * count(*) FILTER (w) / count(*) + 0.5)::BIGINT AS segment FROM sg GROUP BY signal HAVING count(*) >= 2), (SELECT b::BIGINT AS baseline FROM base WHERE n >= 3))"""


@query("a11_closure_patterns", CLOSURE_SQL + " SELECT signal, won, lost, baseline, segment, lift, round(confidence, 4) AS confidence FROM cp ORDER BY lift DESC, signal LIMIT 8")
def closure_patterns(t: Tables) -> DataFrame:
    """Win rate of six segments of closed deals against all; the eight with the greatest lift."""
    return A.closure_patterns(deals(t), outreach(t)).withColumn("confidence", F.round("confidence", 4))


MESH_SQL = """, mz AS (SELECT *, meta_pixel IS NOT TRUE AS no_pixel, tag_manager IS NOT TRUE AS no_gtm, lower(trim(coalesce(email, ''))) IN ('', 'n/d') AS no_email, lower(trim(coalesce(phone, ''))) IN ('', 'n/d') AS no_phone, coalesce(site, 'N/D') = 'N/D' AS no_website, score >= 70 AS hot FROM lead)"""


@query("a12_gap_shares", MESH_SQL + ", s AS (SELECT unnest(['no_pixel', 'no_gtm', 'no_email', 'no_phone', 'no_website', 'hot_score']) AS signal, unnest([count(*) FILTER (no_pixel), count(*) FILTER (no_gtm), count(*) FILTER (no_email), count(*) FILTER (no_phone), count(*) FILTER (no_website), count(*) FILTER (hot)]) AS n, count(*) AS total FROM mz) SELECT signal, n, floor(100.0::DOUBLE * n / total + 0.5)::BIGINT AS pct FROM s WHERE n > 0")
def gap_shares(t: Tables) -> DataFrame:
    return A.gap_shares(leads(t))


@query("a12_mesh_categories", MESH_SQL + " SELECT category, count(*) AS n, floor(avg(score) + 0.5)::BIGINT AS mean_score, floor(100.0::DOUBLE * count(*) FILTER (no_pixel) / count(*) + 0.5)::BIGINT AS no_pixel_pct, floor(100.0::DOUBLE * count(*) FILTER (NOT no_email) / count(*) + 0.5)::BIGINT AS with_email_pct FROM mz GROUP BY category ORDER BY n DESC, category LIMIT 8")
def mesh_categories(t: Tables) -> DataFrame:
    return A.mesh_groups(leads(t), "category")


@query("a12_mesh_cities", MESH_SQL + " SELECT city, count(*) AS n, floor(avg(score) + 0.5)::BIGINT AS mean_score FROM mz GROUP BY city ORDER BY n DESC, city LIMIT 8")
def mesh_cities(t: Tables) -> DataFrame:
    return A.mesh_groups(leads(t), "city").select("city", "n", "mean_score")


@query("a12_shared_contacts", MESH_SQL + " SELECT (SELECT count(*) FROM (SELECT phone FROM mz WHERE NOT no_phone GROUP BY regexp_replace(phone, '[^0-9]', '', 'g'), phone HAVING count(*) >= 2)) AS phones, (SELECT count(*) FROM (SELECT lower(email) FROM mz WHERE NOT no_email GROUP BY 1 HAVING count(*) >= 2)) AS emails")
def shared_contacts(t: Tables) -> DataFrame:
    return A.shared_contacts(leads(t))


STATS_SQL = ", st AS (SELECT city, count(*) AS total, count(*) FILTER (meta_pixel IS NOT TRUE) AS no_pixel, count(*) FILTER (lower(trim(coalesce(email, ''))) NOT IN ('', 'n/d')) AS with_email, floor(avg(score) + 0.5) AS mean FROM lead GROUP BY city)"


@query("a13_mesh_from_stats", STATS_SQL + " SELECT sum(total)::BIGINT AS total, sum(no_pixel)::BIGINT AS no_pixel, sum(total - with_email)::BIGINT AS no_email, floor(100.0::DOUBLE * sum(no_pixel) / sum(total) + 0.5)::BIGINT AS no_pixel_pct, sum(total) FILTER (mean >= 70)::BIGINT AS hot FROM st")
def mesh_from_stats(t: Tables) -> DataFrame:
    """The mesh's shares from each segment's totals alone, as if its rows were there."""
    return A.mesh_from_stats(A.segment_stats(leads(t)))


@query("a14_segment_totals", """, top AS (SELECT city, string_agg(category || '=' || n, ',' ORDER BY n DESC, category) AS top_categories FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, category) AS r FROM (SELECT city, category, count(*) AS n FROM lead GROUP BY ALL)) WHERE r <= 5 GROUP BY city)
 SELECT city, count(*) AS total, floor(avg(score) + 0.5)::BIGINT AS mean_score, count(*) FILTER (lower(trim(coalesce(email, ''))) NOT IN ('', 'n/d')) AS with_email, count(*) FILTER (lower(trim(coalesce(phone, ''))) NOT IN ('', 'n/d')) AS with_phone, count(*) FILTER (meta_pixel IS NOT TRUE) AS no_pixel, count(*) FILTER (ssl = false) AS no_ssl, any_value(top_categories) AS top_categories FROM lead JOIN top USING (city) GROUP BY city""")
def segment_totals(t: Tables) -> DataFrame:
    rows = leads(t)
    totals = A.segment_stats(rows).select("city", "total", F.col("mean").alias("mean_score"), "with_email", "with_phone", "no_pixel", "no_ssl")
    return totals.join(A.top_in_group(rows, "city", "category", 5), "city")


@query("a16_best_category", DEALS_SQL + ", c AS (SELECT category, floor(100.0::DOUBLE * count(*) FILTER (stage = 'vinto') / count(*) FILTER (stage IN ('vinto', 'perso')) + 0.5)::BIGINT AS win_rate, round(sum(deal_value) FILTER (stage = 'vinto'), 2) AS revenue FROM de JOIN lead ON lead.id = de.lead GROUP BY category HAVING count(*) FILTER (stage IN ('vinto', 'perso')) > 0) SELECT category, win_rate, revenue FROM c ORDER BY win_rate DESC, revenue DESC, category LIMIT 1")
def best_category(t: Tables) -> DataFrame:
    rows = deals(t).join(leads(t).select(F.col("id").alias("lead"), "category"), "lead")
    return A.best_group(rows, "category")


PKI_SQL = CLOSURE_SQL + """, p AS (SELECT count(*) FILTER (stage = 'vinto') AS won, count(*) FILTER (stage = 'perso') AS lost, count(*) FILTER (stage NOT IN ('vinto', 'perso')) AS active, count(*) FILTER (stage NOT IN ('vinto', 'perso') AND day < 10575 - 7) AS stagnant FROM de),
 o AS (SELECT floor(100.0::DOUBLE * count(*) FILTER (status IN ('replied', 'interested')) / count(*) + 0.5) AS response, floor(100.0::DOUBLE * count(*) FILTER (status = 'interested') / count(*) + 0.5) AS interest FROM ou),
 e AS (SELECT count(DISTINCT city) AS envs, count(*) AS total, least(8, count(DISTINCT category)) AS cats FROM lead), b AS (SELECT count(*) AS knowledge FROM benchmark),
 x AS (SELECT least(100, greatest(0, floor(100.0::DOUBLE * won / (won + lost) * 0.55::DOUBLE + interest * 0.25::DOUBLE + response * 0.2::DOUBLE + 0.5))) AS conversion, least(100, greatest(0, floor(100 - 100.0::DOUBLE * stagnant / active * 1.2::DOUBLE + least(20, active * 2) + 0.5))) AS velocity,
   least(100, greatest(0, floor(response * 0.5::DOUBLE + interest * 0.5::DOUBLE + 0.5))) AS quality, least(100, greatest(0, floor(least(40, envs * 8) + least(35, total / 2.0::DOUBLE) + least(25, cats * 5) + 0.5))) AS coverage, least(100, knowledge * 6) AS knowledge FROM p, o, e, b),
 y AS (SELECT *, floor(conversion * 0.3::DOUBLE + velocity * 0.25::DOUBLE + quality * 0.2::DOUBLE + coverage * 0.15::DOUBLE + knowledge * 0.1::DOUBLE + 0.5) AS score FROM x)"""


@query("a17_composite_report", PKI_SQL + " SELECT conversion::BIGINT AS conversion, velocity::BIGINT AS velocity, quality::BIGINT AS quality, coverage::BIGINT AS coverage, knowledge::BIGINT AS knowledge, score::BIGINT AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade, (SELECT signal FROM cp WHERE lift > 0 ORDER BY lift DESC, signal LIMIT 1) AS top_lift FROM y")
def composite_report(t: Tables) -> DataFrame:
    """Five components and their weighted score in one row."""
    return A.composite(deals(t), outreach(t), leads(t), t.raw("benchmark"), today=10575)


@query("a19_action_list", DEALS_SQL + """, a AS (SELECT * FROM (SELECT 'stagnant' AS type, CASE WHEN n >= 3 THEN 'critical' ELSE 'warning' END AS severity, n FROM (SELECT count(*) AS n FROM de WHERE stage NOT IN ('vinto', 'perso') AND day < 10575 - 7) UNION ALL
   SELECT 'urgent_proposal', 'critical', count(*) FROM de WHERE stage = 'proposta' AND day < 10575 - 3 UNION ALL SELECT 'hot_uncontacted', 'warning', count(*) FROM de WHERE stage = 'nuovo' AND score >= 70 UNION ALL SELECT 'stale_meeting', 'warning', count(*) FROM de WHERE stage = 'meeting' AND day < 10575 - 5 UNION ALL
   SELECT 'stale_leads', CASE WHEN count(*) >= 10 THEN 'warning' ELSE 'info' END, count(*) FROM lead WHERE floor(greatest(0, 100 - audited_days / 30.0::DOUBLE * 100) + 0.5) < 50 UNION ALL SELECT 'unread_alerts', 'warning', count(*) FROM sig WHERE kind = 'error' AND confidence >= 90 UNION ALL SELECT 'monitored_leads', 'info', count(DISTINCT lead) FROM sig WHERE kind = 'purchase' UNION ALL
   SELECT 'outreach_followup', 'critical', count(*) FROM ou WHERE status = 'sent' AND day < 10575 - 3 UNION ALL SELECT 'sequence_pending', 'info', count(*) FROM ou WHERE status = 'sent' AND channel = 'email' AND day > 11000) WHERE n > 0)
 SELECT type, severity, n FROM a ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, type""")
def action_list(t: Tables) -> DataFrame:
    """Nine rules that have something to do, by severity."""
    return A.actions(deals(t), outreach(t), leads(t), signals(t), today=10575)


@query("a7_recent_counts", "SELECT id, (SELECT count(*) FROM ev WHERE entity_id = ent.id AND occurred_at >= TIMESTAMP '2024-01-01' AND occurred_at < TIMESTAMP '2024-01-31') AS events, (SELECT count(*) FROM rel WHERE source_id = ent.id) AS relationships, (SELECT count(*) FROM obs WHERE entity_id = ent.id) AS observed FROM ent", bound="graph")
def recent_counts(t: Tables) -> DataFrame:
    """Events of thirty days, outgoing edges and observations of each entity."""
    recent = t.events().where("occurred_at >= timestamp '2024-01-01' and occurred_at < timestamp '2024-01-31'")
    return graph.with_counts(t.entities(), recent, t.relationships(), t.observations()).select("id", "events", "relationships", "observed")


@query("a24_weight_vector", ", w AS (SELECT f, count(*) AS n, count(*) FILTER (rating >= 4) AS np, count(*) FILTER (rating < 3) AS nn, avg(v) FILTER (rating >= 4) AS p, avg(v) FILTER (rating < 3) AS m FROM (SELECT rating, unnest(['score', 'reviews', 'load']) AS f, unnest([score::DOUBLE, reviews * 2.0::DOUBLE, load_seconds * 10::DOUBLE]) AS v FROM lead) WHERE v IS NOT NULL GROUP BY f) SELECT f AS factor, round(greatest(3, least(45, CASE f WHEN 'score' THEN 30.0::DOUBLE WHEN 'reviews' THEN 20.0 ELSE 10.0 END * CASE WHEN n < 5 OR np < 2 OR nn < 2 OR abs(p - m) < 8 THEN 1.0::DOUBLE WHEN p > m THEN 1.04 ELSE 0.96 END)), 6) AS weight FROM w")
def weight_vector(t: Tables) -> DataFrame:
    """A new weight for each factor by the difference of its means over good and bad outcomes."""
    factors = {"score": (F.col("score"), 30.0), "reviews": (F.col("reviews") * 2, 20.0), "load": (F.col("load_seconds") * 10, 10.0)}
    return A.adapted_weights(leads(t), factors, F.col("rating") >= 4, F.col("rating") < 3).withColumn("weight", F.round("weight", 6))


# Joins


@query("j4_target_facts", "SELECT id FROM ent WHERE entity_type = 'company' AND id IN (SELECT source_id FROM rel WHERE relationship_type = 'sells_to' AND target_id IN (SELECT id FROM ent WHERE entity_type = 'company' AND contains(lower(name), '1') AND id IN (SELECT entity_id FROM obs WHERE attribute = 'revenue' AND value_num > 300000) AND id IN (SELECT entity_id FROM obs WHERE attribute = 'status' AND value_text = 'P')))", bound="graph")
def target_facts(t: Tables) -> DataFrame:
    wanted = (Observation("revenue", "gt", 300000), Observation("status", "eq", "P"))
    q = Query("company", relationships=(Relationship("sells_to", "out", "company", "1", wanted),), limit=None)
    return execute(q, t.entities(), t.observations(), t.relationships(), t.events()).select("id")


@query("j8_exists", "SELECT id FROM lead WHERE EXISTS (SELECT 1 FROM sig WHERE lead = lead.id AND kind = 'purchase') AND list_contains(tech_stack, 'ga4')")
def exists(t: Tables) -> DataFrame:
    """Leads with a technology and a signal."""
    uses = leads(t).select("id", F.explode("tech_stack").alias("tool")).where("tool = 'ga4'").select("id")
    bought = signals(t).where("kind = 'purchase'").select(F.col("lead").alias("id"))
    return leads(t).select("id").join(uses, "id", "left_semi").join(bought, "id", "left_semi")


@query("j9_collect_both", "SELECT id, coalesce(array_to_string(list_sort(tech_stack), ','), '') AS tech, coalesce(kinds, '') AS signals FROM lead LEFT JOIN (SELECT lead, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM sig GROUP BY lead) k ON k.lead = id")
def collect_both(t: Tables) -> DataFrame:
    """Technologies and signals of each lead, each aggregated before its join."""
    kinds = signals(t).groupBy(F.col("lead").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("signals"))
    rows = leads(t).select("id", F.array_join(F.array_sort("tech_stack"), ",").alias("tech")).join(kinds, "id", "left")
    return rows.select("id", F.coalesce("tech", F.lit("")).alias("tech"), F.coalesce("signals", F.lit("")).alias("signals"))


@query("j14_list_statistics", ", ll AS (SELECT c_custkey % 12 AS list_id, 'c:' || c_custkey AS lead_id FROM customer) SELECT list_id, count(*) AS leads, round(avg(CASE WHEN score > 0 THEN score END), 4) AS mean_score FROM ll JOIN lead ON id = lead_id GROUP BY list_id")
def list_statistics(t: Tables) -> DataFrame:
    members = t.raw("customer").select((F.col("c_custkey") % 12).alias("list_id"), F.concat(F.lit("c:"), "c_custkey").alias("id"))
    rows = members.join(leads(t).select("id", "score"), "id")
    return rows.groupBy("list_id").agg(F.count("*").alias("leads"), F.round(F.avg(F.when(F.col("score") > 0, F.col("score"))), 4).alias("mean_score"))


WATCH_SQL = ", doms AS (SELECT id, regexp_extract(site, '//www\\.([^/]*)', 1) AS domain FROM lead), watch AS (SELECT 'u' || (c_custkey % 7) AS user_id, 'c:' || c_custkey AS entity_id FROM customer WHERE c_custkey % 3 = 0), mon AS (SELECT 'm' || (p_partkey % 5) AS user_id, 'https://www.shop' || (p_partkey % 450) || '.it/x' || p_partkey AS website FROM part)"


@query("j16_alerts", WATCH_SQL + " SELECT DISTINCT user_id, sig.id AS event_id FROM sig JOIN (SELECT user_id, entity_id FROM watch UNION SELECT user_id, doms.id FROM mon JOIN doms ON domain <> '' AND contains(website, domain)) u ON u.entity_id = sig.lead WHERE kind IN ('error', 'purchase')")
def alerts(t: Tables) -> DataFrame:
    """Events for users who keep the entity, and for users who monitor a site whose address contains the entity's domain."""
    keep = t.raw("customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("u"), F.col("c_custkey") % 7).alias("user_id"), F.concat(F.lit("c:"), "c_custkey").alias("entity_id"))
    watched = t.raw("part").select(F.concat(F.lit("m"), F.col("p_partkey") % 5).alias("user_id"), F.concat(F.lit("https://www.shop"), F.col("p_partkey") % 450, F.lit(".it/x"), F.col("p_partkey")).alias("website"))
    domain = F.when(L.present(F.col("site")), C.normalize_domain(F.col("site")))
    sites = leads(t).select(F.col("id").alias("entity_id"), domain.alias("domain")).where("domain is not null")
    # many entities share a domain and many sites of a user hold it: they meet as user and domain, each once
    held = M.containing(watched.distinct(), "website", sites.select("domain").distinct(), "domain").select("user_id", "domain").distinct()
    monitors = held.join(sites, "domain").select("user_id", "entity_id")
    events = signals(t).where(F.col("kind").isin("error", "purchase")).select(F.col("lead").alias("entity_id"), F.col("id").alias("event_id"))
    return events.join(keep.unionByName(monitors).distinct(), "entity_id").select("user_id", "event_id").distinct()


@query("j19_drift_rate", ", doms AS (SELECT DISTINCT regexp_extract(site, '//www\\.([^/]*)', 1) AS d FROM lead WHERE coalesce(site, 'N/D') <> 'N/D'), known AS (SELECT DISTINCT 'shop' || (s_suppkey % 300) || '.it' AS d FROM supplier) SELECT count(*) AS domains, count(*) FILTER (d NOT IN (SELECT d FROM known)) AS missing, round(100.0::DOUBLE * count(*) FILTER (d NOT IN (SELECT d FROM known)) / count(*), 4) AS rate FROM doms")
def drift_rate(t: Tables) -> DataFrame:
    """Domains of leads that the graph doesn't know, and their share."""
    domains = leads(t).where(L.present(F.col("site"))).select(C.normalize_domain(F.col("site")).alias("d")).distinct()
    known = t.raw("supplier").select(F.concat(F.lit("shop"), F.col("s_suppkey") % 300, F.lit(".it")).alias("d")).distinct().withColumn("in", F.lit(True))
    both = domains.join(known, "d", "left").agg(F.count("*").alias("domains"), F.count_if(F.col("in").isNull()).alias("missing"))
    return both.select("domains", "missing", F.round(F.col("missing") * 100.0 / F.col("domains"), 4).alias("rate"))


HYDRATE_SQL = ", st AS (SELECT s_suppkey AS n, 'c:' || (s_suppkey * 3) AS id, 'shop' || s_suppkey || '.it' AS domain, lower('Customer#' || lpad(CAST(s_suppkey * 7 AS VARCHAR), 9, '0')) AS alias, 'p' || s_suppkey AS phone, 's' || s_suppkey || '@x.it' AS email FROM supplier)"


@query("j22_hydrate_keys", HYDRATE_SQL + " SELECT l.id, coalesce(nullif(trim(l.phone), ''), a.phone, b.phone, c.phone) AS phone, coalesce(nullif(trim(l.email), ''), a.email, b.email, c.email) AS email FROM lead l LEFT JOIN st a ON a.id = l.id LEFT JOIN st b ON b.domain = regexp_extract(l.site, '//www\\.([^/]*)', 1) LEFT JOIN st c ON c.alias = lower(l.name)")
def hydrate_keys(t: Tables) -> DataFrame:
    """Blank contacts are filled by id, else by the domain's entity, else by an alias."""
    n = F.col("s_suppkey")
    name = F.lower(F.concat(F.lit("Customer#"), F.lpad((n * 7).cast("string"), 9, "0")))
    known = t.raw("supplier").select(F.concat(F.lit("c:"), n * 3).alias("id"), F.concat(F.lit("shop"), n, F.lit(".it")).alias("domain"), name.alias("alias"), F.concat(F.lit("p"), n).alias("phone"), F.concat(F.lit("s"), n, F.lit("@x.it")).alias("email"))
    rows = leads(t).select("id", F.when(L.present(F.col("site")), C.normalize_domain(F.col("site"))).alias("domain"), F.lower("name").alias("alias"), "phone", "email")
    return M.fill_blanks(rows, known, ["id", "domain", "alias"], ["phone", "email"]).select("id", "phone", "email")


@query("j21_merge_ends", ", mg AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 25 <> 0 THEN c_custkey + 1 ELSE c_custkey END AS nxt FROM customer) SELECT id, least((SELECT max(c_custkey) FROM customer) + CASE WHEN (SELECT max(c_custkey) FROM customer) % 25 <> 0 THEN 1 ELSE 0 END, id + (25 - id % 25) % 25)::BIGINT AS final_id FROM mg")
def merge_ends(t: Tables) -> DataFrame:
    """The end of merge chains of up to 25 links over all customers."""
    k = F.col("c_custkey")
    return graph.resolve_merges(t.raw("customer").select(k.alias("id"), F.when(k % 25 != 0, k + 1).alias("merged_into_id")))


@query("p8_contains_any", "SELECT id FROM ent WHERE id IN (SELECT entity_id FROM obs WHERE contains(lower(coalesce(value_text, CAST(value_num AS VARCHAR))), 'p') OR contains(coalesce(value_text, CAST(CAST(floor(value_num) AS BIGINT) AS VARCHAR)), '777'))", bound="graph")
def contains_any(t: Tables) -> DataFrame:
    """The text form of any value: letters, or whole amounts."""
    text = F.coalesce("value_text", F.floor("value_num").cast("string"))
    hits = t.observations().where(C.contains_ci(F.col("value_text"), "p") | F.contains(text, F.lit("777"))).select("entity_id")
    return t.entities().join(hits, F.col("id") == F.col("entity_id"), "left_semi").select("id")


@query("t1_page_and_total", "SELECT id, last_seen_at, (SELECT count(*) FROM ent WHERE entity_type = 'company' AND contains(lower(city), 'nation_1')) AS total FROM ent WHERE entity_type = 'company' AND contains(lower(city), 'nation_1') ORDER BY last_seen_at DESC NULLS FIRST, id LIMIT 50 OFFSET 10", bound="graph")
def page_and_total(t: Tables) -> DataFrame:
    """A page, and how many rows there were before paging."""
    every = Query("company", city="nation_1", limit=None)
    args = (t.entities(), t.observations(), t.relationships(), t.events())
    total = execute(every, *args).agg(F.count("*").alias("total"))  # one row
    page = execute(Query("company", city="nation_1", offset=10, limit=50), *args)
    return page.select("id", "last_seen_at").join(F.broadcast(total))


# Scalar functions with their own queries


@query("f2_phones", "SELECT id, CASE WHEN phone IS NULL THEN NULL WHEN len(regexp_replace(phone, '[^0-9]', '', 'g')) < 6 THEN NULL ELSE regexp_replace(phone, '[^0-9]', '', 'g') END AS phone FROM lead")
def phones(t: Tables) -> DataFrame:
    return leads(t).select("id", C.normalize_phone(F.col("phone")).alias("phone"))


@query("f3_emails", "SELECT id, CASE WHEN regexp_matches(lower(trim(email)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN lower(trim(email)) END AS email FROM lead")
def emails(t: Tables) -> DataFrame:
    return leads(t).select("id", C.normalize_email(F.col("email")).alias("email"))


@query("f4_vats", "SELECT id, CASE WHEN len(regexp_replace(vat, '[^0-9]', '', 'g')) = 11 THEN 'IT' || vat END AS vat FROM lead")
def vats(t: Tables) -> DataFrame:
    return leads(t).select("id", C.normalize_vat(F.col("vat")).alias("vat"))


@query("f8_folded_words", "SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(regexp_replace(left(coalesce(text, ''), 100000000), '[^A-Za-zàáâäèéêëìíîïòóôöùúûüñç ]', ' ', 'g'))), ' +', ' ', 'g'))) AS folded FROM documents", bound="none")
def folded_words(t: Tables) -> DataFrame:
    """Letters of a text in lower case without accents, single spaces."""
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-zàáâäèéêëìíîïòóôöùúûüñç ]", " ")
    return t.raw("documents").select("doc_id", F.md5(M.folded(letters)).alias("folded"))


@query("f11_matcher_tokens", "SELECT id, list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower(name || ' S.r.l. Italia ' || category), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')), ' ')), lambda w: len(w) >= 2 AND w NOT IN ('srl', 'italia'))) AS tokens FROM lead")
def matcher_tokens(t: Tables) -> DataFrame:
    return leads(t).select("id", F.array_sort(M.name_tokens(F.concat("name", F.lit(" S.r.l. Italia "), "category"))).alias("tokens"))


@query("f12_token_overlap", ", x AS (SELECT id, list_distinct(string_split(lower(category) || ' alpha ' || city, ' ')) AS a, list_distinct(string_split('building alpha beta', ' ')) AS b FROM (SELECT id, category, lower(city) AS city FROM lead)) SELECT id, round(CASE WHEN len(list_intersect(a, b)) = 0 OR len(list_intersect(a, b)) < least(2, len(a), len(b)) THEN 0 ELSE len(list_intersect(a, b))::DOUBLE / greatest(len(a), len(b)) * 100 END, 4) AS overlap FROM x")
def token_overlap(t: Tables) -> DataFrame:
    a = F.array_distinct(F.split(F.concat_ws(" ", F.lower("category"), F.lit("alpha"), F.lower("city")), " "))
    return leads(t).select("id", F.round(M.token_score(a, F.array(*map(F.lit, ("building", "alpha", "beta")))), 4).alias("overlap"))


@query("f22_truncated_freshness", "SELECT id, CASE WHEN audited_days IS NULL THEN 0 ELSE greatest(0, least(100, trunc(100 - audited_days / 30.0::DOUBLE * 100)))::BIGINT END AS freshness FROM lead")
def truncated_freshness(t: Tables) -> DataFrame:
    """The worker's twin cuts the fraction off."""
    score = F.greatest(F.lit(0), F.least(F.lit(100), (F.lit(100.0) - F.col("audited_days") / 30 * 100).cast("long")))
    return leads(t).select("id", F.when(F.col("audited_days").isNull(), 0).otherwise(score).cast("long").alias("freshness"))


@query("f25_numbers", "SELECT id, round(revenue, 2) AS amount FROM lead")
def numbers(t: Tables) -> DataFrame:
    """Amounts that were printed with a dot for thousands and a comma for decimals."""
    printed = F.translate(F.format_number("revenue", 2), ".,", ",.")
    return leads(t).select("id", C.parse_number(printed).alias("amount"))


@query("f33_all_day_keys", "SELECT 'rel' AS what, source_id || ':' || target_id || ':' || relationship_type || ':' || strftime(observed_at, '%Y-%m-%d') AS key FROM rel UNION ALL SELECT 'ev', entity_id || ':' || event_type || ':' || coalesce(md5(payload) || ':', '') || strftime(occurred_at, '%Y-%m-%d') FROM ev", bound="graph")
def all_day_keys(t: Tables) -> DataFrame:
    edges = t.relationships().select(F.lit("rel").alias("what"), C.day_key(F.col("source_id"), F.col("target_id"), F.col("relationship_type"), at=F.col("observed_at")).alias("key"))
    return edges.unionByName(t.events().select(F.lit("ev").alias("what"), C.day_key(F.col("entity_id"), F.col("event_type"), F.md5("payload"), at=F.col("occurred_at")).alias("key")))


@query("w5_registry_growth", ", rg AS (SELECT o_custkey AS id, year(o_orderdate)::BIGINT AS y, sum(o_totalprice) AS revenue, sum(o_orderkey % 90) AS staff FROM orders GROUP BY 1, 2), pr AS (SELECT a.id, a.y, a.staff, a.revenue, b.staff AS s0, b.revenue AS r0 FROM rg a JOIN rg b ON a.id = b.id AND a.y = b.y + 1) SELECT id, y, s0 > 0 AND staff >= s0 * 1.15::DOUBLE AS staff_grew, r0 > 0 AND revenue >= r0 * 1.2::DOUBLE AS revenue_grew FROM pr")
def registry_growth(t: Tables) -> DataFrame:
    """A year against the one before: fifteen percent more staff, twenty more revenue."""
    y = t.raw("orders").groupBy(F.col("o_custkey").alias("id"), F.year("o_orderdate").cast("long").alias("y")).agg(F.sum("o_totalprice").alias("revenue"), F.sum(F.col("o_orderkey") % 90).alias("staff"))
    before = y.select("id", (F.col("y") + 1).alias("y"), F.col("revenue").alias("r0"), F.col("staff").alias("s0"))
    both = y.join(before, ["id", "y"])
    return both.select("id", "y", ((F.col("s0") > 0) & (F.col("staff") >= F.col("s0") * 1.15)).alias("staff_grew"), ((F.col("r0") > 0) & (F.col("revenue") >= F.col("r0") * 1.2)).alias("revenue_grew"))


# State over ordered rows


@query("e6_monotone_results", "SELECT key, max_by(id, n) AS id, count(*) AS seen FROM (SELECT id, CAST(substr(id, 3) AS BIGINT) AS n, coalesce(nullif(site, 'N/D'), name) AS key FROM lead) GROUP BY key ORDER BY min(n) LIMIT 10000")
def monotone_results(t: Tables) -> DataFrame:
    """Batches in order: a key that was shown stays, its newest row is shown, and the list has at most ten thousand rows."""
    rows = leads(t).select("id", F.substring("id", 3, 20).cast("long").alias("n"), F.coalesce(F.nullif(F.col("site"), F.lit("N/D")), "name").alias("key"))
    return Y.accumulated(rows, "key", "n", 10_000).select("key", "id", "seen")


@query("e7_late_patch", ", pt AS (SELECT lead, max_by(kind, (seen_at, id)) AS kind, max(confidence) AS confidence FROM sig WHERE tier = 'official' GROUP BY lead) SELECT id, name, coalesce(kind, 'none') AS newest, coalesce(confidence, 0) AS confidence FROM lead LEFT JOIN pt ON lead = id")
def late_patch(t: Tables) -> DataFrame:
    """Rows patched by what came later; no row is doubled."""
    late = signals(t).where("tier = 'official'").groupBy(F.col("lead").alias("id")).agg(F.max_by("kind", F.struct("seen_at", "id")).alias("kind"), F.max("confidence").alias("confidence"))
    rows = leads(t).select("id", "name").join(late, "id", "left")
    return rows.select("id", "name", F.coalesce("kind", F.lit("none")).alias("newest"), F.coalesce("confidence", F.lit(0)).alias("confidence"))


SNAP_SQL = """, sn AS (SELECT event_id AS id, user_id AS entity, ts AS tm, event_id % 2 = 0 AS meta_pixel, event_id % 3 = 0 AS google_tag_manager, event_id % 5 < 2 AS instagram, event_id % 7 < 3 AS facebook, event_id % 11 > 1 AS email, event_id % 13 > 2 AS site, CASE WHEN event_id % 9 > 0 THEN (20 + event_id % 31) / 10.0::DOUBLE END AS rating FROM events),
 pv AS (SELECT *, lag(id) OVER w AS had, lag(meta_pixel) OVER w AS p1, lag(google_tag_manager) OVER w AS p2, lag(instagram) OVER w AS p3, lag(facebook) OVER w AS p4, lag(email) OVER w AS p5, lag(site) OVER w AS p6, lag(rating) OVER w AS p7 FROM sn WINDOW w AS (PARTITION BY entity ORDER BY tm, id))"""


@query("e8_all_changes", SNAP_SQL + """ SELECT id, unnest(list_filter([CASE WHEN p1 <> meta_pixel THEN 'meta_pixel' || CASE WHEN meta_pixel THEN '+' ELSE '-' END END, CASE WHEN p2 <> google_tag_manager THEN 'google_tag_manager' || CASE WHEN google_tag_manager THEN '+' ELSE '-' END END, CASE WHEN p3 <> instagram THEN 'instagram' || CASE WHEN instagram THEN '+' ELSE '-' END END, CASE WHEN p4 <> facebook THEN 'facebook' || CASE WHEN facebook THEN '+' ELSE '-' END END,
  CASE WHEN p5 <> email THEN 'email' || CASE WHEN email THEN '+' ELSE '-' END END, CASE WHEN p6 <> site THEN 'site' || CASE WHEN site THEN '+' ELSE '-' END END, CASE WHEN abs(rating - p7) >= 0.3::DOUBLE - 1e-9 THEN 'rating' || CASE WHEN rating > p7 THEN '+' ELSE '-' END END, CASE WHEN p6 <> site THEN 'website_status' || CASE WHEN site THEN '+' ELSE '-' END END], lambda x: x IS NOT NULL)) AS change FROM pv WHERE had IS NOT NULL""")
def all_changes(t: Tables) -> DataFrame:
    """Changes between an entity's snapshots: six flags, the rating by 0.3 and more, and the site's status."""
    snaps, flags = snapshots(t.raw("events"))
    return Y.changes(snaps, flags, "rating").select("id", "change")


def snapshots(events: DataFrame) -> tuple[DataFrame, list[str]]:
    """Events as snapshots of their user, and the names of the flags."""
    n = F.col("event_id")
    flags = {"meta_pixel": n % 2 == 0, "google_tag_manager": n % 3 == 0, "instagram": n % 5 < 2, "facebook": n % 7 < 3, "email": n % 11 > 1, "site": n % 13 > 2}
    rating = F.when(n % 9 > 0, (n % 31 + 20) / F.lit(10.0))
    return events.select(n.alias("id"), F.col("user_id").alias("entity"), F.col("ts").alias("at"), *(c.alias(k) for k, c in flags.items()), rating.alias("rating")), list(flags)


@query("e11_circuit_breaker", """WITH ca AS (SELECT event_id AS id, user_id AS lead, epoch_us(ts) / 1000000 AS tm, event_type <> 'error' AS ok FROM events), lf AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY lead ORDER BY tm, id) AS island FROM ca), fl AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY lead, island ORDER BY tm, id) AS failures FROM lf), bf AS (SELECT *, lag(failures) OVER (PARTITION BY lead ORDER BY tm, id) AS f0, lag(tm) OVER (PARTITION BY lead ORDER BY tm, id) AS tm0 FROM fl)
 SELECT id, failures, coalesce(f0, 0) < 3 OR tm - tm0 > 300 AS tried FROM bf""", bound="none")
def circuit_breaker(t: Tables) -> DataFrame:
    """Failures (errors) in a row after each event of a user, and whether the call should have been tried: not within 300 s after three failures."""
    calls = t.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("lead"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return Y.breaker(calls, "lead").select("id", "failures", "tried")


@query("e11_mean_response", "WITH ca AS (SELECT user_id AS lead, value AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS back FROM events WHERE event_type <> 'error' AND value IS NOT NULL) SELECT lead, round(sum(ms * 0.2::DOUBLE * pow(0.8::DOUBLE, back)), 4) AS mean_ms FROM ca GROUP BY lead", bound="none")
def mean_response(t: Tables) -> DataFrame:
    """Exponential mean of the values of a user's events without errors (0.8 of the old, 0.2 of the new, from 0)."""
    calls = t.raw("events").where("event_type <> 'error' and value is not null").select(F.col("user_id").alias("lead"), F.col("value").alias("ms"), "ts", "event_id")
    return Y.exponential_mean(calls, "lead", "ms", ["ts", "event_id"], 0.8).select("lead", F.round("mean", 4).alias("mean_ms"))


# Lifecycle


MERGE_SQL = ", mm AS (SELECT id, CASE WHEN id LIKE 's:%7' THEN 's:' || (CAST(substr(id, 3) AS BIGINT) + 2) WHEN id LIKE 's:%8' THEN 's:' || (CAST(substr(id, 3) AS BIGINT) + 1) ELSE id END AS f FROM ent)"


@query("m2_merged_edges", MERGE_SQL + " SELECT a.f AS source_id, b.f AS target_id, relationship_type, max(confidence) AS confidence FROM rel JOIN mm a ON a.id = source_id JOIN mm b ON b.id = target_id WHERE a.f <> b.f GROUP BY ALL", bound="graph")
def merged_edges(t: Tables) -> DataFrame:
    """All edges with both ends moved to the entity that stays; self-loops go, equal edges keep the surest."""
    return Y.merged_edges(t.relationships(), graph.resolve_merges(t.entities()))


@query("m2_merged_observations", MERGE_SQL + ", ob AS (SELECT CASE WHEN CAST(substr(entity_id, 3) AS BIGINT) % 5 = 0 THEN 's:' || (CAST(substr(entity_id, 3) AS BIGINT) % 90 + 1) ELSE entity_id END AS e, attribute, id, observed_at FROM obs) SELECT coalesce(f, e) AS entity_id, attribute, count(*) AS n, max_by(ob.id, (observed_at, ob.id)) AS newest FROM ob LEFT JOIN mm ON mm.id = e GROUP BY ALL", bound="graph")
def merged_observations(t: Tables) -> DataFrame:
    """Observations moved along: how many each kept entity has of each attribute, and the newest."""
    k = F.substring("entity_id", 3, 20).cast("long")
    moved = t.observations().withColumn("entity_id", F.when(k % 5 == 0, F.concat(F.lit("s:"), k % 90 + 1)).otherwise(F.col("entity_id")))
    rows = Y.moved(moved, "entity_id", graph.resolve_merges(t.entities()))
    return rows.groupBy("entity_id", "attribute").agg(F.count("*").alias("n"), F.max_by("id", F.struct("observed_at", "id")).alias("newest"))


@query("m1_upsert_metadata", "SELECT coalesce(a.id, b.id) AS id, coalesce(a.id, '') = '' AS is_new, CASE WHEN a.id IS NULL THEN map {'category': b.category, 'tier': 'new'}['category'] ELSE coalesce(b.category, a.category) END AS category, CASE WHEN b.id IS NULL THEN 'old' ELSE 'new' END AS tier, a.city AS old_city FROM (SELECT * FROM lead WHERE meta_pixel IS NOT TRUE) a FULL JOIN (SELECT id, category FROM lead WHERE meta_pixel IS DISTINCT FROM false) b ON a.id = b.id")
def upsert_metadata(t: Tables) -> DataFrame:
    """Metadata maps are merged key by key, the new one wins; leads without a pixel flag are on both sides, every other on one."""
    old = leads(t).where("meta_pixel is not true").select("id", F.create_map(F.lit("category"), F.col("category"), F.lit("tier"), F.lit("old"), F.lit("city"), F.col("city")).alias("metadata"))
    new = leads(t).where("meta_pixel is distinct from false").select("id", F.create_map(F.lit("category"), F.col("category"), F.lit("tier"), F.lit("new")).alias("metadata"))
    rows = Y.upsert_metadata(old, new)
    return rows.select("id", "is_new", F.col("metadata")["category"].alias("category"), F.col("metadata")["tier"].alias("tier"), F.col("metadata")["city"].alias("old_city"))


@query("m3_ingest_events", ", si AS (SELECT sig.id, lead, CASE kind WHEN 'signup' THEN 'new_hiring' WHEN 'purchase' THEN 'tender_won' WHEN 'error' THEN 'website_changed' END AS event_type FROM sig) SELECT id, lead AS entity_id, event_type FROM si WHERE event_type IS NOT NULL AND lead IN (SELECT id FROM lead)")
def ingest_events(t: Tables) -> DataFrame:
    """Signals of known leads as events; signal types without an event type are left out."""
    kind = F.when(F.col("kind") == "signup", "hiring").when(F.col("kind") == "purchase", "tender_won").when(F.col("kind") == "error", "site_stale").otherwise("view")
    rows = signals(t).select("id", F.col("lead").alias("entity_id"), R.event_of_signal(kind).alias("event_type")).where("event_type is not null")
    return rows.join(leads(t).select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("id", "entity_id", "event_type")


@query("m5_outreach_drafts", DEALS_SQL + " SELECT 'outreach' AS kind, 'Contact: ' || name AS title, channel || ' · ' || status AS body, CASE status WHEN 'interested' THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM ou JOIN lead ON lead.id = ou.lead WHERE status <> 'sent'")
def outreach_drafts(t: Tables) -> DataFrame:
    """Drafts for the knowledge feed from contacts that were answered."""
    rows = outreach(t).where("status <> 'sent'").join(leads(t).select(F.col("id").alias("lead"), "name"), "lead")
    return rows.select(F.lit("outreach").alias("kind"), F.concat(F.lit("Contact: "), "name").alias("title"), F.concat_ws(" · ", "channel", "status").alias("body"), F.when(F.col("status") == "interested", 0.8).otherwise(0.6).alias("confidence"))


@query("m6_audit_merge", ", au AS (SELECT id, score % 2 = 0 AS has_pixel, score % 3 = 0 AS has_gtm, CASE WHEN score % 4 = 0 THEN 'info@' || substr(id, 3) || '.it' END AS email, '+39 02' || lpad(CAST(score AS VARCHAR), 7, '0') AS phone, load_seconds FROM lead WHERE audited_days IS NOT NULL) SELECT lead.id, coalesce(has_pixel, meta_pixel) AS meta_pixel, coalesce(has_gtm, tag_manager) AS tag_manager, CASE WHEN contains(lead.email, '@') THEN lead.email ELSE coalesce(au.email, lead.email) END AS email, CASE WHEN len(regexp_replace(coalesce(lead.phone, ''), '[^0-9]', '', 'g')) >= 8 THEN lead.phone ELSE coalesce(au.phone, lead.phone) END AS phone, CASE WHEN au.id IS NULL THEN NULL ELSE 100 END AS freshness FROM lead LEFT JOIN au ON au.id = lead.id")
def audit_merge(t: Tables) -> DataFrame:
    """An audit's flags replace the lead's; real contacts of the lead stay."""
    n = F.col("score")
    audit = leads(t).where("audited_days is not null").select("id", (n % 2 == 0).alias("has_pixel"), (n % 3 == 0).alias("has_gtm"), F.when(n % 4 == 0, F.concat(F.lit("info@"), F.substring("id", 3, 20), F.lit(".it"))).alias("email"), F.concat(F.lit("+39 02"), F.lpad(n.cast("string"), 7, "0")).alias("phone"))
    return Y.audited(leads(t), audit).select("id", "meta_pixel", "tag_manager", "email", "phone", "freshness")


@query("m7_digital_twin", f", sg AS (SELECT lead, count(*) AS events, max(seen_at) AS newest FROM sig GROUP BY lead) SELECT id, name, least(100, CASE WHEN meta_pixel IS NOT TRUE THEN 25 ELSE 0 END + CASE WHEN site IS NULL THEN 30 ELSE 0 END + CASE WHEN instagram IS NULL THEN 15 ELSE 0 END + CASE WHEN seo_errors THEN 20 ELSE 0 END + CASE WHEN dmarc = false THEN 10 ELSE 0 END)::BIGINT AS opportunity, array_to_string(list_sort(tech_stack), ',') AS tech, coalesce(events, 0) AS events, least(20, coalesce(events, 0)) AS shown, (len(tech_stack) + 1)::BIGINT AS edges FROM lead LEFT JOIN sg ON lead = id")
def digital_twin(t: Tables) -> DataFrame:
    """A company in one row: score, technologies, events (twenty are shown), edges of its star."""
    return Y.twins(leads(t), signals(t))


@query("m8_star_graph", """, ca AS (SELECT city, category, count(*) AS n, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, category) AS r FROM lead GROUP BY city, category), li AS (SELECT city, score // 25 AS l, count(*) AS n FROM lead GROUP BY ALL)
 SELECT 'env:' || city AS from_id, 'cat:' || replace(lower(category), ' ', '-') AS to_id, round(n::DOUBLE / max(n) OVER (PARTITION BY city), 6) AS weight FROM ca WHERE r <= 6 UNION ALL SELECT 'env:' || city, 'list:' || l, greatest(1, n)::DOUBLE FROM li""")
def star_graph(t: Tables) -> DataFrame:
    """Edges from each segment to its lists (their size) and its six largest categories (their share of the largest)."""
    rows = leads(t).withColumn("list", F.floor(F.col("score") / 25))
    return Y.star_edges(rows, "city", "category", "list", 6).withColumn("weight", F.round("weight", 6))


# Sinks and streams. What is written is read again, so that the rows show what the sink holds.


@query("s9_upsert_sink", "SELECT key, arg_max(id, (n, id)) AS id FROM (SELECT 'k' || (o_orderkey % 500) AS key, o_orderkey AS id, 0 AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'k' || (o_orderkey % 700), o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F') GROUP BY key", bound="none")
def upsert_sink(t: Tables) -> DataFrame:
    """A table (finished orders) and a batch (all others) with the same key: the batch's newest row replaces the table's."""
    k = F.col("o_orderkey")
    old = t.raw("orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("k"), k % 500).alias("key"), k.alias("id"))
    new = t.raw("orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("k"), k % 700).alias("key"), k.alias("id"))
    return sinks.stored(sinks.upsert(old, new, "key", ["id"]), "upsert")


@query("s10_insert_ignore_sink", "SELECT key, min(id) AS id, n FROM (SELECT o_custkey AS key, o_orderkey AS id, 0 AS n FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')) GROUP BY key, n", bound="none")
def insert_ignore_sink(t: Tables) -> DataFrame:
    """Rows whose key the table doesn't have are added, one for each key; the others are ignored."""
    rows = t.raw("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("old"))
    old = rows.where("old").groupBy("key").agg(F.min("id").alias("id")).withColumn("n", F.lit(0))
    new = rows.where("not old").drop("old").withColumn("n", F.lit(1))
    return sinks.stored(sinks.insert_ignore(old, new, "key", "id"), "insert-ignore")


@query("s12_csv_export", "SELECT id, name, city, category, coalesce(site, '') AS site, coalesce(phone, '') AS phone, coalesce(email, '') AS email, CAST(score AS VARCHAR) AS score FROM lead")
def csv_export(t: Tables) -> DataFrame:
    """A CSV export with every field quoted, read again as text."""
    return sinks.csv_round_trip(leads(t).select("id", "name", "city", "category", "site", "phone", "email", "score"), "leads")


@query("e9_archive_split", "SELECT processed AND occurred_at < TIMESTAMP '2024-01-11' AS archived, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ev GROUP BY 1", bound="graph")
def archive_split(t: Tables) -> DataFrame:
    """Old processed events move to an archive by month, the others stay; both written and read again."""
    old = F.col("processed") & (F.col("occurred_at") < F.lit("2024-01-11").cast("timestamp"))
    stay, moved = sinks.split(t.events().select("id", "processed", "occurred_at"), old, "occurred_at")
    both = stay.select("id", F.lit(False).alias("archived")).unionByName(moved.select("id", F.lit(True).alias("archived")))
    return both.groupBy("archived").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def _stream(t: Tables) -> DataFrame:
    schema = t.events().schema
    raw = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events*.parquet").parquet(t.folder)
    rows = raw.select(F.col("event_id").alias("id"), F.concat(F.lit("c:"), "user_id").alias("entity_id"), "event_type", F.col("props").alias("payload"), "value", F.col("ts").alias("occurred_at"), (F.col("event_id") % 3 == 0).alias("processed"))
    return rows.select(*schema.names)


@query("e1_idempotent_stream", "SELECT DISTINCT entity_id || ':' || event_type || ':' || coalesce(md5(payload) || ':', '') || strftime(occurred_at, '%Y-%m-%d') AS dedup_key FROM ev", bound="graph")
def idempotent_stream(t: Tables) -> DataFrame:
    """Events of a stream, one for each key and day, appended to a table."""
    stream = _stream(t).withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))
    return sinks.streamed(S.once_a_day(stream).select("dedup_key"), "append")


@query("e2_consumed_batches", "SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL OR value < 1) AS failed FROM ev WHERE NOT processed GROUP BY event_type", bound="graph")
def consumed_batches(t: Tables) -> DataFrame:
    """Unprocessed events handed on in micro-batches; one that can't be handled fails alone and is marked."""
    done = S.consumed(_stream(t), F.when(F.col("value").isNull() | (F.col("value") < 1), F.lit("no value")), "consumed")
    return done.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("error").isNotNull()).alias("failed"))


@query("e4_subscription", "SELECT id FROM ev WHERE event_type = 'purchase' AND entity_id IN ('c:1', 'c:2', 'c:3', 'c:5', 'c:8')", bound="graph")
def subscription(t: Tables) -> DataFrame:
    """Inserted events of a type and of some entities, from a stream."""
    return sinks.streamed(S.subscribed(_stream(t), ["purchase"], ["c:1", "c:2", "c:3", "c:5", "c:8"]).select("id"), "append")


# Records in full


@query("n26_three_samples", DEALS_SQL + " SELECT * FROM (SELECT 'signal' AS source, lead, confidence::DOUBLE AS score FROM sig ORDER BY seen_at DESC, id DESC LIMIT 80) UNION ALL SELECT * FROM (SELECT 'outreach', lead, CASE status WHEN 'interested' THEN 100.0::DOUBLE WHEN 'replied' THEN 50.0 ELSE 0.0 END FROM ou ORDER BY day DESC, id DESC LIMIT 100) UNION ALL SELECT * FROM (SELECT 'deal', lead, score::DOUBLE FROM de ORDER BY day DESC, id DESC LIMIT 50)")
def three_samples(t: Tables) -> DataFrame:
    """The newest signals, contacts and deals that feed the weights."""
    points = F.when(F.col("status") == "interested", 100.0).when(F.col("status") == "replied", 50.0).otherwise(0.0)
    parts = [
        signals(t).orderBy(F.desc("seen_at"), F.desc("id")).limit(80).select(F.lit("signal").alias("source"), "lead", F.col("confidence").cast("double").alias("score")),
        outreach(t).orderBy(F.desc("day"), F.desc("id")).limit(100).select(F.lit("outreach").alias("source"), "lead", points.alias("score")),
        deals(t).orderBy(F.desc("day"), F.desc("id")).limit(50).select(F.lit("deal").alias("source"), "lead", F.col("score").cast("double").alias("score")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("n30_projection", "SELECT id, name, city, coalesce(nullif(site, 'N/D'), '') AS website, concat_ws(', ', CASE WHEN meta_pixel IS DISTINCT FROM true THEN 'pixel' END, CASE WHEN tag_manager IS DISTINCT FROM true THEN 'tag manager' END, CASE WHEN ssl = false THEN 'ssl' END, CASE WHEN mobile = false THEN 'mobile' END, CASE WHEN seo_errors THEN 'seo' END) AS gaps, score FROM lead")
def projection(t: Tables) -> DataFrame:
    return leads(t).select("id", "name", "city", F.coalesce(F.nullif(F.col("site"), F.lit("N/D")), F.lit("")).alias("website"), L.gap_text().alias("gaps"), "score")


@query("n31_all_options", "SELECT * FROM (SELECT DISTINCT 'category' AS what, category AS value FROM lead WHERE coalesce(category, '') <> '' ORDER BY value LIMIT 500) UNION ALL SELECT * FROM (SELECT DISTINCT 'city', city FROM lead WHERE coalesce(city, '') <> '' ORDER BY city LIMIT 500)")
def all_options(t: Tables) -> DataFrame:
    """Up to five hundred categories and places to choose from."""
    def options(c: str) -> DataFrame:
        return leads(t).where(F.coalesce(c, F.lit("")) != "").select(F.lit(c).alias("what"), F.col(c).alias("value")).distinct().orderBy("value").limit(500)

    return options("category").unionByName(options("city"))


@query("n34_mode_or_newest", "SELECT lead, CASE WHEN max_n > 1 THEN mode_kind ELSE newest END AS kind FROM (SELECT lead, max(n) AS max_n, arg_max(kind, (n, -ascii(kind), -ord(substr(kind, 2, 1)))) AS mode_kind FROM (SELECT lead, kind, count(*) AS n FROM sig GROUP BY ALL) GROUP BY lead) JOIN (SELECT lead, max_by(kind, (seen_at, id)) AS newest FROM sig GROUP BY lead) USING (lead)")
def mode_or_newest(t: Tables) -> DataFrame:
    """The source that occurs most often (ties: the first by name), or the newest where none occurs twice."""
    n = signals(t).groupBy("lead", "kind").agg(F.count("*").alias("n"), F.max(F.struct("seen_at", "id")).alias("at"))
    g = n.groupBy("lead").agg(F.max("n").alias("most"), F.min_by("kind", F.struct((-F.col("n")).alias("m"), "kind")).alias("mode"), F.max_by("kind", "at").alias("newest"))
    return g.select("lead", F.when(F.col("most") > 1, F.col("mode")).otherwise(F.col("newest")).alias("kind"))


@query("n17_worker_signals", "SELECT id, 'crm_installed' AS signal, 85 AS confidence FROM lead WHERE list_contains(tech_stack, 'shopify') UNION ALL SELECT id, 'investing_marketing', 94 FROM lead WHERE active_ads > 0 UNION ALL SELECT id, 'registry_growth', 80 FROM lead WHERE vat IS NOT NULL AND employees >= 50")
def worker_signals(t: Tables) -> DataFrame:
    """Signals that the audit worker makes of a stack, running advertisements and the registry."""
    found = [("crm_installed", F.array_contains("tech_stack", "shopify"), 85), ("investing_marketing", F.col("active_ads") > 0, 94), ("registry_growth", F.col("vat").isNotNull() & (F.col("employees") >= 50), 80)]
    rows = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(n).alias("signal"), F.lit(c).alias("confidence"))) for n, test, c in found]))
    return leads(t).select("id", F.explode(rows).alias("s")).select("id", "s.*")


@query("f19_lead_fields", "SELECT id, name AS azienda, CASE WHEN lower(trim(coalesce(site, ''))) IN ('', 'n/d') THEN '' ELSE site END AS sito, CASE WHEN lower(trim(coalesce(phone, ''))) IN ('', 'n/d') THEN '' ELSE phone END AS telefono, CASE WHEN contains(email, '@') AND split_part(email, '@', 2) <> 'example.com' THEN email ELSE '' END AS email, CASE WHEN score % 2 = 0 THEN city ELSE regexp_extract(address, '\\d{5} ([A-Za-z_0-9]+)$', 1) END AS citta, coalesce(meta_pixel, false) AS meta_pixel, coalesce(ssl, true) AS ssl FROM lead")
def lead_fields(t: Tables) -> DataFrame:
    """Fields made uniform: texts that mean none are empty, template addresses too, the place comes from the address where it is missing."""
    rows = leads(t).withColumn("city", F.when(F.col("score") % 2 == 0, F.col("city")))
    clean = lambda c: F.when(L.present(F.col(c)), F.col(c)).otherwise("")
    mail = F.when(L.has_contact(F.lit(None).cast("string"), F.col("email")), F.col("email")).otherwise("")
    place = F.coalesce("city", F.regexp_extract("address", r"\d{5} ([A-Za-z_0-9]+)$", 1))
    return rows.select("id", F.col("name").alias("azienda"), clean("site").alias("sito"), clean("phone").alias("telefono"), mail.alias("email"), place.alias("citta"), F.coalesce("meta_pixel", F.lit(False)).alias("meta_pixel"), F.coalesce("ssl", F.lit(True)).alias("ssl"))
