"""The conversation trie against plain Python; small local buckets force rounds of partitioning."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from lakegraph.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, _ids string, depth int"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    kids, out = defaultdict(list), []
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(saved[k] for k in kids[key])
    for key, who in members.items():
        ends = ",".join(str(c) for c in who if len(whole[c]) == len(key))
        out.append((who[0], len(key), members[key[:-1]][0] if key else None, len(who), len(kids[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows(seed=2, n=320):
    rng = random.Random(seed)
    out = []
    deep = [("user", f"turn {k} é") for k in range(40)]
    for c in range(n):
        kind = rng.random()
        if kind < 0.35:  # a hot conversation and its cut or changed copies
            turns = deep[: rng.choice([40, 40, 40, 7, 25])] + [("user", f"own {rng.randint(0, 3)}")] * rng.choice([0, 0, 1, 2])
        else:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "longer text"])) for _ in range(rng.randint(1, 6))]
        out += [(c, rng.choice([k, k, k, None]) if kind > 0.9 else k, r, t, "x", 1) for k, (r, t) in enumerate(turns)]
    out += [out[5], out[5], (None, 1, "user", "no conversation", "x", 1), (5000, 0, "user", "no base", "x", 1), (5001, 0, "user", "z" * 200_000, "x", 1), (7003, 1, "user", "short, without a base", "x", 1)]
    return out


@pytest.mark.parametrize("local", [prefixtrie.LOCAL_TURNS, 60, 1])
def test_equals_plain(spark, monkeypatch, local):
    monkeypatch.setattr(prefixtrie, "RUN_IDS", 7)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    got = prefixtrie.conversation_trie(df, local)
    want = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    assert got.columns == want and [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows())


def test_one_conversation_and_none(spark):
    one = [(0, 0, "user", "hi", "x", 1), (0, 1, "assistant", "ho", "x", 1)]
    got = prefixtrie.conversation_trie(spark.createDataFrame(one, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(one)
    turnless = [(101, 0, "user", "gone", "x", 1)]  # crc32 takes a first turn that no base gives
    got = prefixtrie.conversation_trie(spark.createDataFrame(turnless, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == plain(turnless)
    assert prefixtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
