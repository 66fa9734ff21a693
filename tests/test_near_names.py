"""Numbered names: nearly alike in most letters, so that pieces would bring nearly all pairs together."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from lakegraph.operators import similarity

SCHEMA = "id string, place string, name string"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_shortened_texts(spark):
    rows = spark.createDataFrame([("abca", k) for k in range(4)], "t string, k int").select("k", similarity._shortened(F.col("t"), F.col("k")).alias("x")).collect()
    assert {r.k: sorted(r.x) for r in rows} == {0: ["abca"], 1: ["aba", "abc", "aca", "bca"], 2: ["aa", "ab", "ac", "ba", "bc", "ca"], 3: ["a", "b", "c"]}


def test_numbered_names_meet_by_letters(spark):
    rng = random.Random(12)
    numbers = [f"customer#{rng.randrange(3_000):0{w}d}" for w in (9, 9, 9, 8, 10) for _ in range(160)]
    left = [(f"l{i}", rng.choice("ab"), x) for i, x in enumerate(numbers)] + [("l-same", "a", numbers[0]), ("l-null", "a", None), ("l-nowhere", None, numbers[0]), ("l-other", "a", "rossi marco")]
    right = [(f"r{i}", rng.choice("ab"), f"customer#{rng.randrange(3_000):09d}") for i in range(300)] + [("r-same", "a", numbers[0]), ("r-again", "a", numbers[0]), ("r-other", "a", "rossi marca"), ("r-empty", "a", "")]
    a, b = spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA)
    rows = similarity.near_names(a, b).collect()
    got = {tuple(r) for r in rows}
    all_pairs = [(i, j, x, y) for i, c, x in left for j, d, y in right if c == d and c and x and y]
    allowed = {(i, j) for i, j, x, y in all_pairs if len(x) + len(y) - 2 * common(x, y) <= (len(x) + len(y)) * 12 // 100}
    sure = {(i, j) for i, j, x, y in all_pairs if SequenceMatcher(None, x, y, autojunk=False).ratio() >= 0.88}
    assert len(rows) == len(got) and sure <= got and allowed <= got and ("l-other", "r-other") in got
    assert {(i, j) for i, j, x, _ in all_pairs if (i, j) in got and len(x) == 18} <= allowed  # met by what they have in common


def test_pairs_that_meet_by_letters_are_near(spark):
    """Of all pairs of numbered names only the near ones come out of the join by letters."""
    names = spark.range(4_000).select(F.lit("x").alias("place"), F.concat(F.lit("customer#"), F.lpad((F.col("id") * 7919 % 900_001).cast("string"), 9, "0")).alias("name"))
    a, b = similarity._named(names, "a"), similarity._named(names.where("crc32(name) % 10 = 0"), "b")
    lengths = similarity._lengths(a, b, 88, strict=False)
    found = similarity._by_letters(a, b, lengths)
    assert [(r.n, r.m, r.common, r.most) for r in lengths.collect()] == [(18, 18, 16, 153.0)]
    assert a.count() < found.count() < 0.05 * a.count() * b.count() and similarity._lengths(a, b, 88, strict=True).isEmpty()
