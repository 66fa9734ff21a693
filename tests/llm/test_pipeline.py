"""The pipeline against plain Python on a small table, and its stages on odd tables."""

import random
import re
from collections import Counter

import corpus_pipeline
from lakegraph.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = " ".join(f"item{k}" for k in range(14))


def made(rng):
    """Clean texts, near and exact copies, junk, passages of the benchmark, rows that the rules reject."""
    word = lambda: "".join(rng.choices("abcdeimnorst", k=rng.randint(3, 8)))
    rows = []
    for i in range(120):
        rows.append((i, " ".join(word() for _ in range(rng.choice([40, 80, 150]))), rng.choice(["en", "fr"]), rng.choice("abc"), 1))
    for i in range(120, 135):  # near copies of long texts
        w = rows[i - 120][1].split()
        w[len(w) // 2] = "changed"
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(140 + k, rows[7][1], "en", "b", 1) for k in range(4)] + [rows[5]]
    rows += [(150 + k, rows[40 + k][1] + f"z{k} " + ITEM.upper() + " more words", "en", "c", 1) for k in range(3)]
    rows += [(160, "too short", "en", "a", 1), (161, None, None, None, None), (162, "again and again " * 30, "en", "a", 1), (163, "x " + ITEM, "en", "b", 1)]
    return rows


def plain_near_groups(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label, moved = list(range(len(rows))), True
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    while moved:
        moved = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                moved = True
    return label


def test_stages_against_plain_python(spark, tmp_path):
    folder, rng = str(tmp_path), random.Random(4)
    rows = made(rng)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/out-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = [tuple(r) for r in docs.collect()]
    # Quality: what the base rules reject goes; of the others the forest takes few, never a labelled clean one beyond its share.
    base = [r for r in rows if not (lambda s: s[0] < 10 or 100 * s[4] > 20 * s[0])(quality.text_stats((r[1] or "").encode()))]
    kept = seen["quality_rules"]
    assert not Counter(kept) - Counter(base) and len(base) - len(kept) <= 8 and {160, 161, 162}.isdisjoint({r[0] for r in kept})
    assert sum(r[0] % 2 == 0 and r[0] < 120 for r in base) - sum(r[0] % 2 == 0 and r[0] < 120 for r in kept) <= 1
    # Near-dedup: one document of each group, that of the least id.
    label = plain_near_groups(kept)
    want = {min(r[0] for r, x in zip(kept, label, strict=True) if x == g) for g in set(label)}
    assert sorted(r[0] for r in seen["near_dedup"]) == sorted(want)
    # Decontamination: hit words go, mostly hit documents too.
    clean = {r[0]: r[1] for r in seen["decontamination"]}
    for i, text, *_ in seen["near_dedup"]:
        hit = re.search(ITEM, text, re.I)
        if hit and len(ITEM.split()) > 0.5 * len(text.split()):
            assert i not in clean
        else:
            assert clean[i] == (text[: hit.start()] + text[hit.end() :] if hit else text)
    # Mixing: whole copies, none more than twice, words near each source's target.
    copies = Counter(seen["mixing"])
    assert set(copies) <= set(seen["decontamination"]) and max(copies.values()) <= 2
    words = lambda rs: sum(len(r[1].split()) for r in rs)
    size = {s: words(r for r in seen["decontamination"] if r[3] == s) for s in "abc"}
    weight, left, target = {"a": 3, "b": 1, "c": 2}, 1.5 * sum(size.values()), {}
    free = set(size)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        target |= {s: 2 * size[s] if s in full else level * weight[s] for s in full or free}
        left -= sum(2 * size[s] for s in full)
        free = free - full if full else set()
    for s in size:
        assert abs(words(r for r in seen["mixing"] if r[3] == s) - target[s]) <= 160
    # Sharding: every copy in a shard, sizes at most one apart, slots without gaps.
    assert Counter(r[:5] for r in seen["sharding"]) == copies
    shards = {k: sorted(r[6] for r in seen["sharding"] if r[5] == k) for k in range(8)}
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    got = corpus_pipeline.run(spark, folder)
    assert Counter(tuple(r) for r in got.collect()) == Counter(seen["sharding"])


def test_stages_on_odd_tables(spark):
    """Clashing names pass, empty tables stay empty."""
    d = "/root/testdata/sf0.001"
    extra = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 40").selectExpr("*", "doc_id as _id", "text as _text", "1 as slot", "2 as _copies", "3 as label")
    for name, stage in corpus_pipeline.STAGES:
        columns = stage(spark, extra.limit(0), d).columns
        assert {*extra.columns, "slot_given"} >= set(extra.columns) and len(columns) >= len(extra.columns), name
        assert stage(spark, extra.limit(0), d).count() == 0, name
    out = extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == extra.columns, name
    assert out.count() > 0
