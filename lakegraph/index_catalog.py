"""Queries of what keeps an index, a state or a manifest; each with SQL that gives the same rows unless it is approximate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakegraph import analytics_catalog, catalog
from lakegraph.catalog import query
from lakegraph.operators import asof, graph, paging, similarity, sketches, substring, vectors
from lakegraph.sources import buckets, sinks
from lakegraph.sources.tables import BINDING_SQL, Tables
from lakegraph.streaming import outbox, states

# Paths, names, probes


@query(
    "j10_reached",
    BINDING_SQL.replace("WITH ent", "WITH RECURSIVE ent", 1)
    + """, step AS (SELECT near, far, max(confidence) AS confidence FROM (SELECT source_id AS near, target_id AS far, confidence FROM rel UNION ALL SELECT target_id, source_id, confidence FROM rel) GROUP BY near, far),
 walk AS (SELECT id AS origin, id AS node, 0 AS hops, 0.0::DOUBLE AS total, id AS path FROM ent WHERE entity_type = 'location'
  UNION ALL SELECT origin, far, hops + 1, (max(struct_pack(t := total + confidence, p := path || '>' || far))).t, arg_min(path || '>' || far, struct_pack(m := -(total + confidence), p := path || '>' || far)) FROM walk JOIN step ON near = node WHERE hops < 4 GROUP BY origin, far, hops + 1),
 best AS (SELECT *, row_number() OVER (PARTITION BY origin, node ORDER BY hops) AS n FROM walk)
 SELECT origin, node, hops, round(total / hops, 6) AS mean_confidence, path FROM best WHERE n = 1 AND hops > 0""",
    bound=False,
)
def reached(t: Tables) -> DataFrame:
    """All that each location reaches in at most four hops, over any edge either way."""
    rows = graph.reached(t.entities().where("entity_type = 'location'"), t.relationships(), most=4, direction="any")
    return rows.select("origin", "node", "hops", F.round("mean_confidence", 6).alias("mean_confidence"), "path")


@query(
    "j18_near_names",
    """WITH a AS (SELECT c_custkey AS id, c_nationkey AS place, lower(c_name) AS name FROM customer), b AS (SELECT s_suppkey AS id, s_nationkey AS place, replace(lower(s_name), 'supplier', 'customer') AS name FROM supplier)
 SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b USING (place) WHERE 2 * levenshtein(a.name, b.name) <= floor((length(a.name) + length(b.name)) * 12 / 100.0)""",
    bound=False,
)
def near_names(t: Tables) -> DataFrame:
    """Customers and suppliers of a nation whose names are so near that the letter ratio is 88 in any case: half as many changes as edits are allowed."""
    a = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("place"), F.lower("c_name").alias("name"))
    b = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("place"), F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("name"))
    found = similarity.near_names(a, b).join(a.select(F.col("id").alias("left_id"), F.col("name").alias("x")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("name").alias("y")), "right_id")
    return found.where(2 * F.levenshtein("x", "y") <= similarity.edits(F.length("x") + F.length("y"), 88)).select("left_id", "right_id")


@query(
    "j13_events_as_of_orders",
    """SELECT o_orderkey AS id, (SELECT arg_max(event_id, (ts, event_id)) FROM events WHERE user_id = o_custkey AND ts <= o_orderdate + INTERVAL 9000 DAY) AS event_id FROM orders""",
    bound=False,
)
def events_as_of_orders(t: Tables) -> DataFrame:
    """For every order the customer's newest event at a date that follows it by 9,000 days; null where there was none."""
    probes = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.expr("o_orderdate + interval 9000 days").alias("at"))
    facts = t.raw("events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"), "event_id")
    return asof.as_of_many(probes, facts, ["event_id"]).select("id", "event_id")


@query("a2_fallback_summary", " SELECT (SELECT count(*) FROM ent WHERE entity_type = 'company' AND merged_into_id IS NULL) AS companies, (SELECT count(*) FROM obs) AS observations, (SELECT count(*) FROM rel) AS relationships, (SELECT count(*) FROM ev) AS events_total")
def fallback_summary(t: Tables) -> DataFrame:
    """The four counts that a summary falls back to."""
    parts = {"companies": t.entities().where("entity_type = 'company' and merged_into_id is null"), "observations": t.observations(), "relationships": t.relationships(), "events_total": t.events()}
    counts = None
    for name, rows in parts.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts])


# Vectors


def _vectors(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query(
    "f38_exact_top_k",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s) SELECT query_id, id, round(c, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10""",
    bound=False,
)
def exact_top_k(t: Tables) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, against all."""
    v = _vectors(t)
    return vectors.exact_nearest(v, v.where("id % 20 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@query("f38_cells_top_k")
def cells_top_k(t: Tables) -> DataFrame:
    """The same by the inverted file; approximate, so without SQL. How many cells are looked at is measured on fifty queries."""
    v = _vectors(t)
    queries, index = v.where("id % 20 = 0"), vectors.CellIndex(v)
    some = sinks.stored(queries.orderBy(F.xxhash64("id"), "id").limit(50), "some-queries")
    return index.nearest(queries, 10, index.probes_for(some, vectors.exact_nearest(v, some, 10)))


@query(
    "t9_clamped_top_k",
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM s) SELECT query_id, id, rank::INTEGER AS rank FROM r WHERE rank <= 50""",
    bound=False,
)
def clamped_top_k(t: Tables) -> DataFrame:
    """A thousand neighbours are asked for, fifty are a page."""
    v = _vectors(t)
    return vectors.exact_nearest(v, v.where("id % 100 = 0"), 1000).select("query_id", "id", "rank")


# Written indexes


@query("p8_indexed_contains", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'casino') OR contains(lower(url), '/DE/1'.lower())", bound=False)
def indexed_contains(t: Tables) -> DataFrame:
    """Pages by parts of their addresses; only files whose trigrams allow it are opened."""
    pages = t.raw("pages").select("page_id", "url")
    index = substring.TrigramIndex(pages, "url", ["url", "page_id"], 16)
    return index.contains("casino").unionByName(index.contains("/DE/1")).distinct()


@query("s4_deep_page", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders QUALIFY position >= 1000 AND position < 1500 OR position >= 1200 AND position < 1700", bound=False)
def deep_page(t: Tables) -> DataFrame:
    """Five hundred orders from position 1,000, newest first, and the five hundred that follow the one at position 1,199."""
    rows = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    pages = paging.WrittenOrder(rows, [F.desc("at"), F.asc("id")], "id", 16)
    first = pages.page(1000, 500).select("id", "position")
    last = pages.page(1199, 1).head()
    return first.unionByName(pages.after(last["id"], 500).select("id", "position")).distinct() if last else first


@query("a27_daily_sketches", "SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-21' GROUP BY event_type", bound=False)
def daily_sketches(t: Tables) -> DataFrame:
    """Distinct users of eighteen days from daily sketches, held against the exact count."""
    e = t.raw("events")
    kept = sinks.stored(sketches.daily(e, "ts", "user_id", ["event_type"]), "sketches")
    about = sketches.distinct_between(kept, ["event_type"], "2024-01-03", "2024-01-20")
    exact = e.where("ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-21'").groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return exact.join(about, "event_type").select("event_type", "exact", (F.abs(F.col("n") - F.col("exact")) <= 1 + sketches.error_bound() * F.col("exact")).alias("near"))


# Tables changed by buckets


def _keyed_orders(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").alias("old"))


@query("s9_bucket_upsert", "SELECT o_custkey AS key, arg_max(o_orderkey, (o_orderstatus <> 'F', o_orderkey)) AS id, arg_max(o_totalprice, (o_orderstatus <> 'F', o_orderkey)) AS price FROM orders GROUP BY o_custkey", bound=False)
def bucket_upsert(t: Tables) -> DataFrame:
    """Finished orders are the table, all others one batch; a batch's newest row replaces a customer's row."""
    rows = _keyed_orders(t)
    table = buckets.created(rows.where("old").drop("old"), "orders", "key", ["id"])
    table.upsert(rows.where("not old").drop("old"), ["id"])
    return table.read()


@query("s10_bucket_insert", "SELECT o_custkey AS key, CASE WHEN bool_or(o_orderstatus = 'F') THEN max(o_orderkey) FILTER (o_orderstatus = 'F') ELSE min(o_orderkey) END AS id FROM orders GROUP BY o_custkey", bound=False)
def bucket_insert(t: Tables) -> DataFrame:
    """Customers without a finished order get their first other one; those who have one stay."""
    rows = _keyed_orders(t).drop("price")
    table = buckets.created(rows.where("old").drop("old"), "orders", "key", ["id"])
    table.insert_ignore(rows.where("not old").drop("old"), "id")
    return table.read()


@query("e9_bucket_retention", "SELECT event_id AS id, event_type FROM events WHERE NOT (event_type = 'click' AND ts < TIMESTAMP '2024-01-11')", bound=False)
def bucket_retention(t: Tables) -> DataFrame:
    """Old clicks leave the table; buckets without any keep their files."""
    e = t.raw("events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("at"))
    table = buckets.created(e, "events", "id", ["at"])
    table.delete((F.col("event_type") == "click") & (F.col("at") < F.lit("2024-01-11").cast("timestamp")))
    return table.read().select("id", "event_type")


# Streams with state

_event_stream = analytics_catalog._stream


@query("e3_outbox", "SELECT event_id AS id, CASE WHEN value IS NULL OR value < 1 THEN 'failed' ELSE 'processed' END AS status, CASE WHEN value IS NULL OR value < 1 THEN 3 ELSE 0 END AS error_count FROM events", bound=False)
def live_outbox(t: Tables) -> DataFrame:
    """Events of an outbox, each attempted until it is processed or has failed three times."""
    stream = _event_stream(t)
    table = outbox.outbox_table(stream, sinks.new_path(t.spark, "outbox"))
    error = F.when(F.col("value").isNull() | (F.col("value") < 1), F.lit("no value"))
    outbox.consume_outbox(stream, table, error, "events", sinks.new_path(t.spark, "outbox-state"))
    outbox.drain(table, error)
    return table.read().select("id", "status", "error_count")


def _table(t: Tables, rows: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    table = buckets.BucketTable.create(t.spark, sinks.new_path(t.spark, name), rows.schema, key, 16)
    with states.settings(t.spark):
        return outbox.into_table(rows, table, order, name, sinks.new_path(t.spark, f"{name}-state"))


@query("e6_stream_results", "SELECT 'c:' || user_id AS key, min(event_id) AS first, max(event_id) AS newest, count(*) AS seen FROM events GROUP BY user_id ORDER BY first LIMIT 10000", bound=False)
def stream_results(t: Tables) -> DataFrame:
    """A list that grows by batches: a user stays where they came first and shows their newest event; ten thousand at most."""
    rows = states.monotone_results(_event_stream(t).select(F.col("entity_id").alias("key"), F.col("id").alias("n")))
    return _table(t, rows, "key", "results", ["seen"]).orderBy("first").limit(10_000)


@query(
    "e7_stream_patches",
    """SELECT 'c:' || c_custkey AS id, c_name AS name, count(DISTINCT event_type || ':' || props) AS n_signals, coalesce(max(length(event_type) + length(props)), 0) AS confidence FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey, c_name""",
    bound=False,
)
def stream_patches(t: Tables) -> DataFrame:
    """Customers patched by what comes for them, before or after; a signal that they have is no change."""
    none = F.lit(None).cast("string")
    raw = t.spark.readStream.schema(t.raw("customer").schema).option("pathGlobFilter", "customer*.parquet").parquet(t.folder)
    leads = raw.select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit(True).alias("is_lead"), F.lit(0).cast("long").alias("at"), F.col("c_name").alias("name"), none.alias("kind"), none.alias("title"), F.lit(0).cast("long").alias("confidence"))
    e = _event_stream(t)
    signals = e.select(F.col("entity_id").alias("id"), F.lit(False).alias("is_lead"), F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("at"), none.alias("name"), F.col("event_type").alias("kind"), F.col("payload").alias("title"), (F.length("event_type") + F.length("payload")).cast("long").alias("confidence"))
    return _table(t, states.late_patches(leads.unionByName(signals)), "id", "patches", ["n_signals"])


@query("e8_stream_changes", catalog._SQL["e8_all_changes"], bound=False)
def stream_changes(t: Tables) -> DataFrame:
    """Changes between an entity's snapshots, from a stream whose last snapshots are kept as state."""
    raw = t.spark.readStream.schema(t.raw("events").schema).option("pathGlobFilter", "events*.parquet").parquet(t.folder)
    snaps, flags = analytics_catalog.snapshots(raw)
    with states.settings(t.spark):
        return sinks.streamed(states.snapshot_changes(snaps, flags), "append")
