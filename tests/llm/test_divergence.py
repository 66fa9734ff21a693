"""Source divergence against plain Python, with small blocks and chunks so that tiles and spans part."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakegraph.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, _lang int, rank int"


def plain(rows, min_docs=3, top=200):
    docs = defaultdict(list)
    for _, text, lang, source, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or "", source or ""].append(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
    out = []
    for lang in {k[0] for k in docs}:
        mine = {s: ws for (g, s), ws in docs.items() if g == lang}
        seen = Counter(t for ws in mine.values() for w in ws for t in set(w))
        kept = sorted(t for t in seen if seen[t] >= min_docs)
        count = {s: Counter(t for w in ws for t in w if seen[t] >= min_docs) for s, ws in mine.items()}
        whole = sum(count.values(), Counter())

        def shares(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in count.items()}
        q = shares(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in mine:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked[:most])]
    return sorted(out)


def rows(seed=3):
    rng = random.Random(seed)
    words = "Alpha beta gamma DELTA Été naïve zeta Ünder 日本 x1y two-part _ 99 don't".split()
    out = []
    for i in range(150):
        text = " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))
        source = rng.choice(["hot"] * 3 + [f"s{k}" for k in range(9)] + [None, ""])
        out.append((i, rng.choice([text, text, text, None]), rng.choice(["en", "en", "de", None]), source, i, i))
    out += [out[0]] * 3
    out += [(900, "lonely words only", "xx", "a", 1, 1), (901, None, "xx", "b", 1, 1), (902, " .,!", "yy", "a", 1, 1)]
    out += [(903, "longer " * 60_000 + "end", "en", "long", 1, 1)]
    return out


@pytest.mark.parametrize("width, block, span", [(8192, 32, 64), (3, 2, 2), (4, 1, 1)])
def test_equals_plain(spark, monkeypatch, width, block, span):
    for name, v in (("WIDTH", width), ("BLOCK", block), ("SPAN", span)):
        monkeypatch.setattr(divergence, name, v)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    got = divergence.source_divergence(df, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows(), top=4)


def test_empty_table(spark):
    assert divergence.source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_share_is_exact():
    rng = random.Random(5)
    for _ in range(500):
        whole = rng.randint(1, 9 * 10**15)
        count = rng.randint(0, whole - 1)
        assert int(divergence.share(np.array([count]), whole)[0]) == 1 + 10**9 * (count + 1) // whole
