import math

import pytest
from pyspark.sql import functions as F

from lakegraph.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def units(text):
    raw = text.encode("utf-16-be")
    return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw), 2)]


@pytest.mark.parametrize("text", ["", "a", "acme.it", "https://example.com/à?q=1", "\U0001f600 long " * 40])
def test_hashes(spark, text):
    h = 5381
    for u in units(text):
        h = (h * 33 + u) % 2**32
    assert int(one(spark, X.stable_hash(F.lit(text))), 36) == h
    p = 0
    for u in units(text):
        p = (p * 31 + u) % 2**32
    assert one(spark, X.page_hash(F.lit(text))) == f"h{abs(p - 2**32 if p >= 2**31 else p):x}"
    assert one(spark, X.stable_hash(F.lit(None).cast("string"))) is None


def test_sentiment(spark):
    def of(text, stars=None):
        return one(spark, X.sentiment(F.lit(text).cast("string"), F.lit(stars).cast("int")))

    assert of("Ottimo locale, molto pulito") == pytest.approx(2.5 / 3, abs=1e-3)
    assert of("non buono") == pytest.approx(-1 / 3, abs=1e-3)
    assert of("pessimo", 5) == pytest.approx(0.2, abs=1e-3)
    assert of(None) == 0 and of("", 1) == pytest.approx(-0.4) and of("top", 9) == pytest.approx(1 / 3, abs=1e-3)
    assert [one(spark, X.sentiment_label(F.lit(x))) for x in (0.26, 0.25, -0.3)] == ["positive", "neutral", "negative"]


def test_detectors(spark):
    pages = {"<link href='/WP-content/x'> shopify": "WordPress", "<div id='comp-1'>": "Wix", "MyShopify.com": "Shopify", "squarespace": "Squarespace", "<p>": "Custom HTML", None: "Custom HTML"}
    for html, name in pages.items():
        assert one(spark, X.site_builder(F.lit(html).cast("string"))) == name
    records = F.array(F.lit("x"), F.lit("V=spf1 a"), F.lit("v=spf1 +all"))
    assert one(spark, X.mail_policy(records, "spf")) == "ok" and one(spark, X.mail_policy(records, "dmarc")) == "missing"
    hits = one(spark, X.keyword_snippets(F.lit("\n We sell\nPumps here"), ["pumps", "valves", "we"]))
    assert [tuple(h) for h in hits] == [("pumps", "We sell Pumps here"), ("we", "We sell Pumps here")]
    assert one(spark, X.keyword_snippets(F.lit(""), ["a"])) == []


def test_hashed_vector(spark):
    got = [r.v for r in spark.createDataFrame([("Perché PERCHE x",), ("",), (None,), ("acme pompe acme",)], "t string").select(X.hashed_vector(8)("t").alias("v")).collect()]

    def fnv(token):
        h = 2166136261
        for c in token.encode():
            h = (h ^ c) * 16777619 % 2**32
        return h

    want = [0.0] * 8
    for token in ("acme", "pompe", "acme"):
        want[fnv(token) % 8] += (1 if fnv(token) % 2 == 0 else -1) * (1 + len(token) % 5 / 10)
    norm = math.sqrt(sum(v * v for v in want))
    assert got[3] == pytest.approx([v / norm for v in want])
    assert sum(v != 0 for v in got[0]) == 1 and sum(v * v for v in got[0]) == pytest.approx(1)
    assert got[1] == got[2] == [0.0] * 8
