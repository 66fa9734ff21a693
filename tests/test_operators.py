"""Operators on small tables whose results are plain to see."""

from pyspark.sql import functions as F

from lakegraph.functions import leads as L
from lakegraph.functions import records as R
from lakegraph.operators import graph
from lakegraph.operators import lifecycle as Y
from lakegraph.operators import matching as M
from lakegraph.plans.query import Observation, predicate
from lakegraph.sources import sinks


def test_predicates_by_type(spark):
    rows = spark.createDataFrame([("a", None), ("True", None), ("7", None), (None, 7.0), (None, None)], "value_text string, value_num double").withColumn("n", F.monotonically_increasing_id())

    def found(*args):
        return {(r.value_text, r.value_num) for r in rows.where(predicate(Observation("x", *args))).collect()}

    assert found("eq", True) == {("True", None)}
    assert found("in", ("a", 7)) == {("a", None), (None, 7.0)}
    assert found("in", ()) == set()
    assert found("contains", "7") == {("7", None), (None, 7.0)}
    assert found("is_null") == {(None, None)}


def test_containing_is_exact(spark):
    texts = spark.createDataFrame([(1, "www.shop1.it"), (2, "shop12.it/x"), (3, None), (4, ""), (5, "shop1.itshop1.it")], "t int, text string")
    needles = spark.createDataFrame([("a", "shop1.it"), ("b", "12"), ("c", ""), ("d", None), ("e", "shop12.it/xyz")], "n string, needle string")
    got = sorted((r.t, r.n) for r in M.containing(texts, "text", needles, "needle").collect())
    assert got == [(1, "a"), (2, "b"), (5, "a")]
    assert M.containing(texts, "text", needles.limit(0), "needle").count() == 0


def test_paths(spark):
    edges = spark.createDataFrame([("a", "b", "k", 0.9, 5), ("c", "b", "k", 0.5, 9), ("b", "d", "m", 1.0, 2), ("c", "d", "m", 1.0, 30), ("c", "a", "k", 1.0, 1)], "source_id string, target_id string, relationship_type string, confidence double, age_days long")
    start = spark.createDataFrame([("a",)], "id string")
    rows = graph.paths(start, edges, [("k", "any", None), ("m", "out", None)]).collect()
    assert [(r.origin, r.node, r.path, round(r.mean_confidence, 3), r.age_days) for r in rows] == [("a", "d", "a>c>d", 1.0, 1)]
    assert graph.paths(start, edges, [("k", "out", start.limit(0))]).count() == 0
    assert [r.node for r in graph.paths(start, edges, [("k", "in", None)]).collect()] == ["c"]


def test_merge_chains_of_any_length(spark):
    rows = [(i, i + 1 if i < 1000 else None) for i in range(1001)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2001), (3000, 9999)]
    got = {r.id: r.final_id for r in graph.resolve_merges(spark.createDataFrame(rows, "id long, merged_into_id long")).collect()}
    assert all(got[i] == 1000 for i in range(1001)) and {got[i] for i in (2000, 2001, 2002, 2003)} == {2000} and got[3000] == 9999


def test_hits_or_all(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert L.hits_or_all(rows, rows.where("id = 2")).count() == 2
    assert L.hits_or_all(rows, spark.createDataFrame([(9,)], "id int")).count() == 3


def test_breaker_and_means(spark):
    calls = spark.createDataFrame([(i, "s", float(at), ok) for i, (at, ok) in enumerate([(0, True), (1, False), (2, False), (3, False), (10, False), (400, True), (401, False)])], "id int, source string, at double, ok boolean")
    got = {r.id: (r.failures, r.tried) for r in Y.breaker(calls, "source").collect()}
    assert got == {0: (0, True), 1: (1, True), 2: (2, True), 3: (3, True), 4: (4, False), 5: (0, True), 6: (1, True)}
    values = spark.createDataFrame([("s", 100.0, 1), ("s", 50.0, 2)], "source string, v double, n int")
    assert abs(Y.exponential_mean(values, "source", "v", ["n"], 0.8).first()["mean"] - (0.8 * 20 + 0.2 * 50)) < 1e-9


def test_sinks(spark):
    old = spark.createDataFrame([("k", 1), ("l", 2)], "key string, id int")
    new = spark.createDataFrame([("k", 0), ("k", -5), ("m", 3)], "key string, id int")
    assert {tuple(r) for r in sinks.upsert(old, new, "key", ["id"]).collect()} == {("k", 0), ("l", 2), ("m", 3)}
    assert {tuple(r) for r in sinks.insert_ignore(old, new, "key", "id").collect()} == {("k", 1), ("l", 2), ("m", 3)}
    odd = spark.createDataFrame([('a "quoted", text\nwith a line', None), ("", "é")], "x string, y string")
    assert {tuple(r) for r in sinks.csv_round_trip(odd, "odd").collect()} == {('a "quoted", text\nwith a line', ""), ("", "é")}


def test_page_differences(spark):
    row = spark.range(1).select(
        R.plain_diff(F.lit("In 2024, on 1/2/23: accept Cookie and cookie")).alias("a"),
        R.novel_terms(F.lit("old words stay"), F.lit("other words staying here and newer things")).alias("b"),
        R.reply_intent(F.lit("Non interessa, no grazie"))[0].alias("c"),
    ).first()
    assert row.a == "In YYYY, on DATE: accept  and cookie" and row.b == ["other", "staying", "newer", "things"] and row.c == "not_interested"
