"""Strength of signals: the order of the sums is fixed, so that means at a half are the SQL's."""

import random

from pyspark.sql import functions as F

from lakegraph.operators import commercial as K

#: Urgency of two pieces of evidence and pain of two: 48.5 on paper, 48.49... as the SQL adds up.
HALVES = [("urgency", 45, 0.6 + 1 * 0.08), ("pain", 52, 0.6 + 2 * 0.06)]
SCHEMA = "id string, type string, score long, confidence double"


def plain(rows):
    """The SQL's sum: rounded confidence times weight, in the signals' order."""
    a = b = 0.0
    for kind, score, confidence in sorted(rows, key=lambda r: list(K.WEIGHTS).index(r[0])):
        w = round(confidence, 4) * K.WEIGHTS[kind]
        a, b = a + score * w, b + w
    return int(a / b + 0.5)


def test_strength_adds_in_the_signals_order(spark):
    rng = random.Random(4)
    groups = {"half": HALVES, "half-back": HALVES[::-1], "one": HALVES[:1]}
    for i in range(300):
        groups[f"r{i}"] = [(k, rng.randint(20, 100), rng.choice([0.6, 0.65]) + rng.randint(1, 5) * rng.choice([0.06, 0.07, 0.08])) for k in rng.sample(list(K.WEIGHTS), rng.randint(1, 7))]
    rows = [(i, *r) for i, g in groups.items() for r in g]
    rng.shuffle(rows)
    got = {r.id: r.strength for r in K.strength(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert got == {i: plain(g) for i, g in groups.items()} and got["half"] == got["half-back"] == 48
    assert K.strength(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_boosted_strength_at_a_half(spark):
    found = K.strength(spark.createDataFrame([(i, *r) for i in ("a", "b", "c") for r in HALVES], SCHEMA))
    boosts = spark.createDataFrame([("a", 10), ("b", -8)], "id string, boost long")
    rows = found.join(boosts, "id", "left").select("id", K.boosted(F.col("strength"), F.col("boost")).alias("score")).collect()
    assert {r.id: r.score for r in rows} == {"a": 58, "b": 40, "c": 48}
