"""Companies matched with and without a look at names that are only alike."""

import random

from lakegraph.operators import matching as M

COLS = "id string, name string, city string, vat string, domain string, phone string"


def companies():
    rng = random.Random(21)
    some = lambda values: rng.choice([None, *values])
    left = [(f"l{i}", f"Customer#{rng.randrange(60):09d}", rng.choice(["Roma", "Roma Nord", "Milano", ""]), some([f"{rng.randrange(20):011d}"]), some([f"shop{rng.randrange(30)}.it"]), some([f"+39 3{rng.randrange(30):09d}"])) for i in range(120)]
    right = [(f"r{i}", f"Customer#{rng.randrange(60):09d}", rng.choice(["Roma", "Milano", "roma nord"]), some([f"{rng.randrange(20):011d}"]), some([f"shop{rng.randrange(30)}.it"]), some([f"3{rng.randrange(30):09d}"])) for i in range(60)]
    return left, right


def test_exact_reasons_need_no_letters(spark, monkeypatch):
    left, right = companies()
    a, b = spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS)
    exact = "accepted and reason in ('vat', 'domain', 'phone', 'name and city')"
    rows = lambda df: sorted((r.lead_id, r.record_id, r.reason, r.score) for r in df.where(exact).collect())
    every = rows(M.match_companies(a, b))
    assert {r[2] for r in every} == {"vat", "domain", "phone", "name and city"}
    monkeypatch.setattr(M, "named_alike", lambda *_: 1 / 0)
    assert rows(M.match_companies(a, b, letters=False)) == every


def test_parts_of_texts_go_to_no_broadcast(spark):
    texts, needles = spark.createDataFrame([(1, "www.shop1.it/x"), (2, "shop1.it shop2.it"), (3, None)], "i long, text string"), spark.createDataFrame([("shop1.it",), ("shop2.it",), ("",)], "needle string")
    found = M.containing(texts, "text", needles, "needle")
    assert sorted((r.i, r.needle) for r in found.collect()) == [(1, "shop1.it"), (2, "shop1.it"), (2, "shop2.it")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
