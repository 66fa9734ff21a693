"""Similarity joins, frontiers, as-of merges, vector cells and written indexes against brute force."""

import random
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegraph.operators import asof, graph, paging, similarity, sketches, substring, vectors
from lakegraph.operators import matching as M

SYLLABLES = "ro ssi mar co bian chi pom pe ter mo tec ni ca ver di im pi an ti lo gi sti ka zu wo".split()


def name(rng, words):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(words))


def mistyped(rng, text):
    """One changed, lost, added or swapped letter in every word."""
    out = []
    for w in text.split():
        k = rng.randrange(len(w))
        out.append({0: w[:k] + rng.choice("xyz") + w[k + 1 :], 1: w[:k] + w[k + 1 :], 2: w[:k] + rng.choice("xyz") + w[k:], 3: w[:k] + w[k : k + 2][::-1] + w[k + 2 :]}[rng.randrange(4)])
    return " ".join(out)


def lists(seed, n):
    rng = random.Random(seed)
    left = [(f"l{i}", rng.choice(["roma", "milano"]), name(rng, rng.randint(1, 3))) for i in range(n)]
    right = [(f"r{i}", c, rng.choice([x, mistyped(rng, x), mistyped(rng, mistyped(rng, x)), name(rng, 2)])) for i, (_, c, x) in enumerate(left)]
    odd = [("l-null", "roma", None), ("l-empty", "roma", ""), ("l-noplace", None, "rossi"), ("l-a", "roma", "a"), ("l-ab", "roma", "ab"), ("l-long", "roma", "ab" * 300), ("l-é", "roma", "è città ü")]
    return left + odd, right + [(i.replace("l-", "r-"), c, x) for i, c, x in odd] + [right[0]]


@pytest.mark.parametrize("least", [80, 88, 95])
def test_near_names_loses_no_pair(spark, least):
    left, right = lists(1, 220)
    schema = "id string, place string, name string"
    a, b = spark.createDataFrame(left, schema).repartition(4), spark.createDataFrame(right, schema)
    got = {tuple(r) for r in similarity.near_names(a, b, least).collect()}
    ratio = lambda x, y: SequenceMatcher(None, x, y, autojunk=False).ratio() * 100
    all_pairs = {(i, j): ratio(x, y) for i, c, x in left for j, d, y in right if c == d and c and x and y}
    assert {k for k, r in all_pairs.items() if r >= least} <= got <= set(all_pairs)
    assert sum(all_pairs[k] >= least for k in got) > 0.3 * len(got)  # few others are let through
    assert similarity.near_names(a.limit(0), b).isEmpty()


def test_candidates_grow_with_the_names(spark):
    counts = []
    for n in (400, 1600):
        left, right = lists(5, n)
        schema = "id string, place string, name string"
        counts.append(similarity.near_names(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).count())
    assert counts[1] < 8 * counts[0]  # all pairs would be sixteen times as many


def test_companies_with_an_error_in_every_word(spark):
    rng = random.Random(8)
    cols = "id string, name string, city string, vat string, domain string, phone string"
    names = [name(rng, 2) for _ in range(120)]
    left = [(f"l{i}", x, "Roma" if i % 3 else "", None, None, None) for i, x in enumerate(names)]
    right = [(f"r{i}", mistyped(rng, x), "Roma", None, None, None) for i, x in enumerate(names)] + [("r-in", "The " + names[0] + "x", "Roma", None, None, None)]
    got = {(r.lead_id, r.record_id) for r in M.match_companies(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)).where("accepted").collect()}
    want = {(a[0], b[0]) for a in left for b in right if a[1] in b[1] or b[1] in a[1] or SequenceMatcher(None, a[1], b[1].lower()).ratio() * 100 >= 88}
    assert got == want and ("l0", "r-in") in got and len(got) > 30


def plain_reach(starts, edges, most):
    out = {}
    steps = defaultdict(dict)
    for a, b, c in edges:
        if a and b and a != b:
            steps[a][b] = max(c, steps[a].get(b, -1))
    for s in {x for x in starts if x}:
        front, seen, hops = {s: (0.0, s)}, {s}, 0
        while front and (most is None or hops < most):
            hops += 1
            new = {}
            for node, (total, path) in front.items():
                for far, c in steps[node].items():
                    if far not in seen:
                        best = (-(total + c), f"{path}>{far}")
                        new[far] = min(best, new.get(far, best))
            front = {n: (-m, p) for n, (m, p) in new.items()}
            seen |= set(front)
            out |= {(s, n): (hops, round(t / hops, 9), p) for n, (t, p) in front.items()}
    return out


@pytest.mark.parametrize("most, hub", [(None, 3), (2, 50_000), (0, 5)])
def test_reached(spark, most, hub):
    rng = random.Random(3)
    ids = [f"n{i}" for i in range(40)]
    edges = [(rng.choice(ids[:30]), rng.choice(ids), rng.choice([0.25, 0.5, 1.0])) for _ in range(70)]
    edges += [("hub", i, 0.5) for i in ids[:20]] + [(ids[3], "hub", 1.0), ("hub", "hub", 1.0), (None, "n1", 1.0), ("n1", None, 1.0), edges[0]]
    edges += [(f"c{i}", f"c{i + 1}", 1.0) for i in range(25)] + [("c25", "c0", 1.0)]  # a long cycle
    df = spark.createDataFrame([(*e, "k") for e in edges], "source_id string, target_id string, confidence double, relationship_type string")
    starts = ["n0", "n1", "n1", "hub", "c0", "nowhere", None]
    rows = graph.reached(spark.createDataFrame([(s,) for s in starts], "id string"), df, most, hub=hub).collect()
    got = {(r.origin, r.node): (r.hops, round(r.mean_confidence, 9), r.path) for r in rows}
    assert len(got) == len(rows) and got == plain_reach(starts, edges, most)
    assert graph.reached(spark.createDataFrame([], "id string"), df).isEmpty()


def test_as_of_over_ranges(spark):
    rng = random.Random(6)
    facts = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(50)]), i, f"v{i}") for i in range(400)] + [("hot", 7, 1000, None)]
    probes = [(i, rng.choice(["hot"] * 6 + ["a", "c", None]), rng.choice([None, *range(-2, 55)])) for i in range(500)]
    probes += [probes[0]]
    f = spark.createDataFrame(facts, "key string, at long, id long, v string").repartition(5)
    p = spark.createDataFrame(probes, "id long, key string, at long").repartition(5)
    got = sorted((tuple(r) for r in asof.as_of_many(p, f, ["v"]).collect()), key=repr)

    def plain(key, at):
        rows = [(a, i, v) for k, a, i, v in facts if k == key and None not in (k, a, at) and a <= at]
        return max(rows)[2] if rows else None

    assert got == sorted(((i, k, a, plain(k, a)) for i, k, a in probes), key=repr)
    assert asof.as_of_many(p.limit(0), f, ["v"]).isEmpty() and asof.as_of_many(p, f.limit(0), ["v"]).where("v is not null").isEmpty()


def test_vector_cells(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    v = v.unionByName(spark.createDataFrame([(9_000, None)], v.schema)).repartition(3)
    q = v.where("id % 20 = 0")
    exact = vectors.exact_nearest(v, q, 10)
    rows = {r.id: np.array(r.embedding, float) for r in v.collect() if r.embedding}
    unit = {i: x / np.linalg.norm(x) for i, x in rows.items()}
    want = {(i, j) for i in rows if i % 20 == 0 for j in sorted(unit, key=lambda j: (-round(float(unit[i] @ unit[j]), 12), j))[:10]}
    assert {(r.query_id, r.id) for r in exact.collect()} == want
    index = vectors.CellIndex(v, cells=16)
    assert index.placed.count() == len(rows)  # every vector is in it
    few = q.where("id % 60 = 0")
    probes = index.probes_for(few, vectors.exact_nearest(v, few, 10))
    found = index.nearest(q, 10, probes)
    assert probes < 16 and vectors.recall(found, exact).head()[0] >= 0.9
    assert {(r.query_id, r.id) for r in index.nearest(q, 10, probes=16).collect()} == want
    assert [vectors.clamped(k) for k in (-3, 0, 7, 1000)] == [1, 1, 7, 50]
    assert vectors.exact_nearest(v.limit(0), q, 3).isEmpty() and vectors.CellIndex(v.limit(0)).nearest(q, 3).isEmpty()


def test_trigrams_prune_files(spark):
    rows = [(i, f"{w} street {i % 7}") for i in range(300) for w in [SYLLABLES[i % 25] * 3]] + [(1000, None), (1001, ""), (1002, "ab")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    index = substring.TrigramIndex(df, "text", ["text"], 10)
    for needle in ("SSISSI", "street 3", "kakaka s", "ab", "", "no such text", "bianbian"):
        got = sorted(r.id for r in index.contains(needle).collect())
        assert got == sorted(i for i, t in rows if t is not None and needle.lower() in t), needle
    some, every = index.files("ssissi"), index.files("street")
    assert len(some) <= 2 < len(every) and index.files("ab") is None and index.files("zzz") == []
    assert len(index.contains("ssissi").inputFiles()) == len(some)


def test_pages_join_to_the_full_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(20)])) for i in range(523)]
    df = spark.createDataFrame(rows, "id long, at long").repartition(4)
    order = [F.desc_nulls_first("at"), F.asc("id")]
    pages = paging.WrittenOrder(df, order, "id", 8)
    want = [r.id for r in df.orderBy(*order).collect()]
    assert pages.total() == 523
    got = [r for at in range(0, 600, 50) for r in pages.page(at, 50).collect()]
    assert [r.id for r in got] == want and [r.position for r in got] == list(range(523))
    assert len(pages.page(400, 20).inputFiles()) <= 2 < pages.index.count()
    assert [r.id for r in pages.after(want[99], 30).collect()] == want[100:130]
    assert pages.after(-1, 5).isEmpty() and pages.page(0, 0).isEmpty() and pages.page(-5, 3).count() == 0
    assert paging.WrittenOrder(df.limit(0), order, "id", 8).page(0, 10).isEmpty()


def test_sketches_merge_within_their_bound(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("user"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 9 as int))").alias("at"), (F.col("id") % 2).alias("g"))
    rows = rows.unionByName(spark.createDataFrame([(None, None, 0)], rows.schema))
    kept = sketches.daily(rows, "at", "user", ["g"])
    assert kept.count() == 18
    for first, last in (("2024-01-01", "2024-01-10"), ("2024-01-03", "2024-01-04")):
        exact = {r.g: r.n for r in rows.where(F.col("at").between(first, f"{last} 23:59:59")).groupBy("g").agg(F.count_distinct("user").alias("n")).collect()}
        about = {r.g: r.n for r in sketches.distinct_between(kept, ["g"], first, last).collect()}
        assert exact.keys() == about.keys() and all(abs(about[g] - exact[g]) <= sketches.error_bound() * exact[g] for g in exact)
    assert sketches.distinct_between(kept, ["g"], "2030-01-01", "2030-01-02").isEmpty()
