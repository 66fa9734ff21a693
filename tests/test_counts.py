"""Running counts over a width and shares of tokens, against plain Python."""

import random

from pyspark.sql import functions as F

from lakegraph.functions import columns as C
from lakegraph.operators import analytics as A


def test_counts_over_a_width(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(0, 60, 3), 50, 51])) for i in range(500)] + [(900, "once", 7)]
    df = spark.createDataFrame(rows, "id long, k string, t long").repartition(5)
    got = {r.id: r.n for r in A.counted_back(df, "k", "t", 10).collect()}
    near = lambda x, y: y is None if x is None else y is not None and x - 10 <= y <= x
    assert got == {i: sum(k == c and near(t, u) for _, c, u in rows) for i, k, t in rows}
    assert A.counted_back(df.limit(0), "k", "t", 10).isEmpty()
    plan = A.counted_back(df, "k", "t", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan  # a row's frame is not gone through for each row


def test_shares_of_tokens(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [(" ".join(rng.choices(words[: rng.randint(1, 40)], k=rng.randint(0, 30))) + "  ", " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(80)] + [("a", None), (None, "a"), ("", "")]

    def plain(a, b):
        if a is None:
            return None
        a, b = a.split()[:12], None if b is None else b.split()[:12]
        if b is None:
            return 0.0 if a else 1.0
        return sum(x in b for x in a) / max(len(a), len(b)) if a or b else 1.0

    share = C.token_similarity(F.col("a"), F.col("b"), 12)
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i long, a string, b string")
    assert {r.i: r.s for r in rows.select("i", share.alias("s")).collect()} == {i: plain(*t) for i, t in enumerate(texts)}


def test_no_text_is_cut_for_each_token(spark):
    """Inside the look-up of a token only names of lists stand; before, the second text was cut anew for each token of the first."""
    df = spark.createDataFrame([("a b", "a c")], "a string, b string")
    plan = df.select(C.token_similarity(F.col("a"), F.upper("b")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(" in plan and "array_contains(slice" not in plan and plan.count("split(upper") == 1
