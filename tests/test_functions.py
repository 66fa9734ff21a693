import datetime

import pytest
from pyspark.sql import functions as F

from lakegraph.functions import columns as C
from lakegraph.operators import graph
from lakegraph.plans.query import Observation, Query, Relationship, execute, explain_plan
from lakegraph.streaming import events as stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_identities(spark):
    s = F.lit
    assert one(spark, C.normalize_domain(s("https://www.Example.IT/"))) == "example.it"
    assert one(spark, C.normalize_domain(s("foo.it:80/x?y"))) == "foo.it"
    assert one(spark, C.normalize_domain(s(None).cast("string"))) is None
    assert [one(spark, C.normalize_phone(s(x))) for x in ("+39 333 123 4567", "3331234567", "123")] == ["393331234567", "393331234567", None]
    assert [one(spark, C.normalize_email(s(x))) for x in (" Test@EXAMPLE.com ", "invalid")] == ["test@example.com", None]
    assert [one(spark, C.normalize_vat(s(x))) for x in ("12345678901", "IT 123.4567.8901", "123")] == ["IT12345678901", "IT12345678901", None]
    assert one(spark, C.slug_technology(s("Meta Pixel"))) == "meta_pixel"
    assert one(spark, C.slug_location(s("Roma"), s("IT"))) == "it:roma"
    assert one(spark, C.slug_name(s("Edil Costruzioni Srl"))) == "edil-costruzioni-srl"
    assert one(spark, C.canonical_company(s(None).cast("string"), s("12345678901"), s("3331234567"))) == "IT12345678901"


def test_numbers(spark):
    assert [one(spark, C.half_up(F.lit(x))) for x in (2.5, -2.5)] == [3, -2]
    assert one(spark, C.parse_number(F.lit("1.234,5"))) == 1234.5 and one(spark, C.parse_number(F.lit("x"))) is None
    assert [one(spark, C.freshness(F.lit(x).cast("double"))) for x in (None, 0.0, 30.0, 15.0)] == [0, 100, 0, 50]
    assert one(spark, C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == pytest.approx(1)


def test_text(spark):
    assert "services" in one(spark, C.strip_html(F.lit("<body><h1>our services</h1><script>x</script></body>")))
    assert one(spark, C.token_similarity(F.lit("a b a"), F.lit("a b c"))) == 1.0
    assert one(spark, C.token_similarity(F.lit(""), F.lit(""))) == 1.0


def frames(spark):
    at = datetime.datetime(2020, 1, 1)
    e = spark.createDataFrame([("a", "company", "A", "X", "k", 0.9, None, None), ("b", "company", "B", "Y", "k", 0.5, at, "c"), ("c", "company", "C", "Y", "k", 0.5, at, "d"), ("d", "company", "D", None, None, 0.5, at, None), ("j", "job", "python dev", None, None, 0.5, at, None)], "id string, entity_type string, name string, city string, category string, confidence double, last_seen_at timestamp, merged_into_id string")
    o = spark.createDataFrame([("1", "a", "crm", "old", None, at), ("2", "a", "crm", "new", None, at + datetime.timedelta(1)), ("3", "b", "size", None, 5.0, at)], "id string, entity_id string, attribute string, value_text string, value_num double, observed_at timestamp")
    r = spark.createDataFrame([("a", "j", "hires", 0.5), ("a", "b", "knows", 0.5), ("b", "d", "knows", 1.0), ("a", "c", "knows", 0.9), ("c", "d", "knows", 0.6)], "source_id string, target_id string, relationship_type string, confidence double")
    v = spark.createDataFrame([], "entity_id string, event_type string, occurred_at timestamp")
    return e, o, r, v


def test_structured_query(spark):
    f = frames(spark)
    ids = lambda q: [r.id for r in execute(q, *f).collect()]
    assert ids(Query("company", observations=(Observation("crm", "eq", "old"),))) == ["a"]  # any age of fact counts
    assert ids(Query("company", relationships=(Relationship("hires", target_type="job", target_name="PYTHON"),))) == ["a"]
    assert ids(Query("company", relationships=(Relationship("hires", target_name="nothing"),))) == []
    assert ids(Query("company", exclude_merged=True)) == ["a", "d"]
    assert ids(Query("company"))[0] == "a"  # null dates first
    with pytest.raises(ValueError):
        Observation("x", "like", 1)
    assert explain_plan(Query("company", city="X"))[1] == "city contains X"


def test_paths_and_merges(spark):
    e, _, r, _ = frames(spark)
    best = graph.best_paths(e.where("id = 'a'"), r, [("knows", "out"), ("knows", "out")]).collect()
    assert [(x.node, x.path) for x in best] == [("d", "a>b>d")]
    assert {x.id: x.final_id for x in graph.resolve_merges(e).collect()}["b"] == "d"


def test_long_chains_and_cycles(spark):
    chain = [(f"k{i:02}", f"k{i + 1:02}" if i < 40 else None) for i in range(41)]
    rings = [("a", "b"), ("b", "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("m", "z"), ("A", "m"), ("p", "q"), ("q", "r"), ("r", "s"), ("s", "p"), ("o", "o"), ("g", "gone")]
    e = spark.createDataFrame(chain + rings, "id string, merged_into_id string")
    want = {i: "k40" for i, _ in chain} | dict(a="a", b="a", x="x", y="x", z="x", m="x", A="x", p="p", q="p", r="p", s="p", o="o", g="gone")
    assert {x.id: x.final_id for x in graph.resolve_merges(e).collect()} == want
    assert {x.id: x.final_id for x in graph.resolve_merges(e, most=1).collect()} == want


def test_streaming(spark, tmp_path):
    src = spark.range(20).selectExpr("id", "concat('c:', id % 3) as entity_id", "'view' as event_type", "'{}' as payload", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id) as occurred_at", "id % 2 = 0 as processed")
    src.write.parquet(str(tmp_path / "in"))
    seen = []
    q = stream.consume(stream.event_stream(spark, str(tmp_path / "in"), src.schema), lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(seen) == list(range(1, 20, 2))
    out = stream.once_a_day(stream.event_stream(spark, str(tmp_path / "in"), src.schema))
    q = out.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 3
    state = stream.retry_state(spark.createDataFrame([(2, True), (0, True), (1, False)], "error_count int, failed boolean"))
    assert [r.status for r in state.collect()] == ["failed", "pending", "processed"]
