"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import random
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lakegraph.llm import chat, decontam, langid, mixing, quality, sharding, simhash, tokencount, urlfilter

WORDS = "the of and tion ing er on re st en at le ou ha nd th an in ed or es is to it by".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices(WORDS, k=rng.randint(1, 3))) for _ in range(n))


def rows(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = prose(rng, rng.choice([3, 30, 60, 200]))
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "b", "b", None]), len(text)))
    long = prose(rng, 150)
    for i in range(6):  # near copies of one long text
        w = long.split()
        w[3 * i] = "changed"
        out.append((n + i, " ".join(w), "en", "a", 1))
    out += [out[0], out[0], (900, None, None, None, None), (901, "", "en", "a", 0), (902, " \n\t ", "en", "a", 4), (None, "no id here at all", "en", "b", 5), (903, prose(rng, 6000), "fr", "c", 9)]
    out += [(904 + i, out[7][1], "en", "b", 1) for i in range(5)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# 1


def test_curve_steps_to_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = [[(n >> (bits * k)) & ((1 << bits) - 1) for k in range(dims)] for n in range(1 << (dims * bits))]
        df = spark.createDataFrame(cells, [f"c{k}" for k in range(dims)])
        df = df.select(*(df[c].cast("int") for c in df.columns))
        got = df.select("*", sharding.hilbert_index([df[c] for c in df.columns], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in got] == list(range(len(cells)))
        assert all(sum(abs(a[k] - b[k]) for k in range(dims)) == 1 for a, b in zip(got, got[1:], strict=False))


def test_sharding(spark, docs):
    got = sharding.shard_documents(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in rows())
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(8))
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    order = [r.curve for k in sorted(by) for r in sorted(by[k], key=lambda r: r.slot)]
    assert order == sorted(order)
    assert sharding.shard_documents(empty(spark)).count() == 0
    clash = docs.withColumn("shard", docs.doc_id).withColumn("_pos", docs.doc_id)
    out = sharding.shard_rows(clash)
    assert out.count() == docs.count() and set(out.columns) == {*docs.columns, "_pos", "shard_given", "shard", "slot", "curve"}


def test_shards_prune(spark, tmp_path):
    """Row-group statistics of the written shards rule out most rows for a filter on any dimension."""
    import pyarrow.parquet as pq

    rng = random.Random(2)
    rows = [(i, "x" * 2 ** rng.randrange(12), rng.choice("abcdefgh"), rng.choice("stuvwxyz"), 1) for i in range(4000)]
    made = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.length("text"))
    sharding.write_shards(sharding.hilbert_shards(made, ["source", "lang"], F.col("size"), [F.col("doc_id")], shards=64), str(tmp_path / "s"))
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "s").rglob("*.parquet")]
    assert sum(f.num_rows for f in files) == 4000

    def read(column, low, high):
        kept = 0
        for f in files:
            at = f.schema.names.index(column)
            for g in range(f.num_row_groups):
                s = f.row_group(g).column(at).statistics
                kept += f.row_group(g).num_rows * (s.min <= high and s.max >= low)
        return kept

    assert read("source", "c", "c") < 2600 and read("lang", "a", "a") < 2600 and read("size", 1, 1) < 2600
    assert read("source", "c", "c") + read("lang", "a", "a") + read("size", 1, 1) < 6500


# 2


def brute_hits(words, items):
    hit, found = set(), set()
    for item, w in items:
        m = min(10, len(w))
        for p in range(len(w) - m + 1) if m else []:
            for q in range(len(words) - m + 1):
                if words[q : q + m] == w[p : p + m]:
                    hit |= set(range(q, q + m))
                    found.add(item)
    return hit, found


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_decontamination(spark, block):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([1, 3, 9, 10, 25]))) for i in range(12)] + [(50, None), (51, "..."), (3, "dup dup dup"), (52, "a a a a a a a a a a a a")]
    items += [items[2], (None, prose(rng, 14)), (None, "dup dup dup"), (None, None)]
    texts = [prose(rng, 40) for _ in range(6)] + [prose(rng, 20) + " " + items[k][1].upper() + ". " + prose(rng, 9) for k in range(12)] + ["a " * 30, "dup dup dup dup", None, "", items[4][1][:-3], items[17][1], "dup dup dup dup", prose(rng, 3000) + " " + items[11][1]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(lower(t or "").encode())
    got = decontam.find_hits(docs, "text", bench, block_bytes=block).withColumn("n", decontam.n_hit()).collect()
    for r in got:
        hit, found = brute_hits(split(texts[r.doc_id]), [(i if i is None else str(i), split(t)) for i, t in items])
        assert (r._n_words, r.n, set(r._items)) == (len(split(texts[r.doc_id])), len(hit), found), r
        assert len(r._items) == len(found) and r._items == sorted(r._items, key=lambda x: (x is None, x))
    digest = {r.doc_id: r for r in decontam.document_hits(docs, bench).collect()}
    r = next(x for x in got if len(x._items) > 1)
    assert digest[r.doc_id].items_sha256 == hashlib.sha256(",".join(x for x in r._items if x).encode()).hexdigest() and digest[r.doc_id].contaminated
    assert decontam.document_hits(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.document_hits(docs.limit(0), bench).count() == 0
    clash = decontam.find_hits(docs.withColumn("_items", docs.doc_id).withColumn("_scan", docs.doc_id), "text", bench, block_bytes=block)
    assert {"_items_given", "_scan_given", "_items"} <= set(clash.columns) and clash.count() == len(texts)
    clean = {r.doc_id: r.text for r in decontam.cleaned_rows(docs, bench.where("length(text) > 60")).collect()}
    assert clean[0] == texts[0] and all(not brute_hits(split(t), [(i, split(x)) for i, x in items if x and len(x) > 60])[0] for t in clean.values())


# 3


def test_url_filter(spark):
    urls = [None, "", "no host", "http://A.b.Example.com/en/7x?q", "https://example.com/en/8", "https://x.net/de/1", "ftp://m.example.net/de/88#f", "http://free-bets.example.com", "https://m.free-bets.example.com/fr/1", "http://notfree-bets.example.com/", "http://a.org/es/", "x://y://z/en/", "http://com/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.page_verdicts(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.b.example.com", "/en/7x", "example.com/en/7", "allow")
    assert [got[i][2:] for i in (4, 5, 6, 7, 8, 9, 10, 12)] == [("com/en/", "block"), ("net/de/", "allow"), ("example.net/de/8", "block"), (None, "block"), (None, "block"), (None, "allow"), ("org/es/", "block"), ("com/en/", "block")]
    assert got[11][:2] == ("y:", "//z/en/")
    assert urlfilter.page_verdicts(pages.limit(0)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most_bytes", [1 << 20, 1000])
def test_cascade_is_exact(spark, most_bytes):
    universe = spark.range(4000).selectExpr("concat('k', id) as key")
    listed = universe.where("pmod(hash(key), 3) = 0")
    shards, cascades = urlfilter.build_cascades(listed.unionByName(listed), universe.unionByName(universe), most_bytes)
    assert shards == (1 if most_bytes > 1000 else 2)
    cascades = list(cascades)
    assert all(len(c.levels) > 2 and c.bytes < most_bytes * 1.3 for c in cascades)
    asked = universe.selectExpr("key", "array(key) as ks")
    got = set()
    for k, c in enumerate(cascades):
        mine = asked.where(urlfilter.shard_of(asked.key, shards) == k)
        got |= {r.key for r in mine.where(urlfilter.any_listed(mine, mine.ks, c)).collect()}
    assert got == {r.key for r in listed.collect()}
    pages = universe.selectExpr("monotonically_increasing_id() as page_id", "concat('http://', key, '/') as url", "1 as _HOST")
    judged = urlfilter.judge_urls(pages, "url", listed, most_bytes=most_bytes)
    assert "Join" not in plan_of(judged) and {"_HOST_given", "_host", "_verdict"} <= set(judged.columns)
    assert {r._host for r in judged.where("_verdict = 'block'").collect()} == got and judged.count() == 4000


def test_listed_pages(spark):
    urls = ["http://a.x/p?utm_source=f", "https://a.x/p", "http://a.x/p/", "http://A.X/p#utm_source=", "http://b.x?utm_source=f", "http://b.x/q", "utm_source=", None, "http://a.x/p"]
    got = {r.page_id: r.verdict for r in urlfilter.page_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [got[i] for i in range(9)] == ["block", "block", "allow", "block", "block", "block", "allow", "allow", "block"]


def test_equally_long_rules(spark):
    pages = spark.createDataFrame([("http://ab.c/de/f",)], "url string")
    rules = (("ab.c/de/", "block"), ("b.c/de/f", "allow"), ("c/de/f", "allow"))
    assert urlfilter.judge_urls(pages, "url", pages.selectExpr("url as key").limit(0), rules).first()._rule == "ab.c/de/"


# 4


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokencount.VOCABULARY)
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    alphabet = [*"abcXYZ 0159.,'!?-\n\t\r", "the ", "don't ", "é", "ß", "İ", "Σ", "ç", " ", "\x1c", "́", "漢", "😀", "<|endoftext|>", "<|", "²", "½", "ŉ", "Ÿ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "word " * 5000, "x" * 3000]
    got = {r.doc_id: r for r in tokencount.document_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), repr(t)
    whole = tokencount.prove_whole_tokens(library, tokencount.word_pattern(library.to_str()))
    assert len(whole) > 10_000 and all(len(library.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::50])


# 6


def test_chat(spark):
    rng = random.Random(2)
    data = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice(["a<|end|>b", "&lt;", "&amp;lt; <", "é\n", None, "", prose(rng, 20)])) for c in range(5) for t in range(6)]
    data += [(9, t, "assistant" if t % 2 else "user", f"<|turn|>{t}") for t in range(700)] + [(3, 1, "user", "tie"), (None, 1, "user", "x"), (4, None, "assistant", "first")]
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)).collect()}
    data += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    by = defaultdict(list)
    for c, t, r, x in data:
        by[c].append(((t is not None, t or 0), r or "", chat_escape(x or ""), x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        text = "".join(f"{r}\n{x}\n" for _, r, _, x in turns)
        loss = "".join(x for _, r, _, x in turns if r == "assistant")
        assert got[c].formatted_chars == sum(len(f"<|turn|>{chat_escape(r)}<|body|>{chat_escape(x)}<|end|>") for _, r, _, x in turns)
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c


def chat_escape(s):
    return s.replace("&", "&amp;").replace("<", "&lt;")


def test_chat_parts(spark):
    parts = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <", None, None), ("image", None, "s3://i", 85), None, ("audio", None, "a.wav", None), (None, "end", None, None)]), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {parts}")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|turn|>user<|body|>see &lt;<|image:1|><|audio:2|>end<|end|><|turn|>assistant<|body|><|end|>"
    assert [tuple(a) for a in r.attachments] == [(1, 1, 1, "image", "s3://i", 85), (2, 1, 2, "audio", "a.wav", 0)]
    assert [tuple(x) for x in r.spans] == [(r.formatted.index("assistant") + len("assistant<|body|>"),) * 2 + (2,)]
    said = spark.createDataFrame([([("text", "<|image:1|> &lt; &amp;", None, None), ("document", None, "d.pdf", 7), ("image", None, "i", 1), ("text", "z", None, None)],), (None,), ([("text", "", None, None)],)], f"p {parts}")
    seen = said.select(chat.visit(F.col("p")).alias("v")).select(chat.read_parts(F.col("v.text"), F.col("v.attachments")).alias("p"), "v.tokens").collect()
    assert [[tuple(x) for x in r.p] for r in seen] == [[("text", "<|image:1|> &lt; &amp;", None, None), ("document", None, "d.pdf", 7), ("image", None, "i", 1), ("text", "z", None, None)], [], []]
    assert [r.tokens for r in seen] == [8, 0, 0]
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_chat_attachments_run_through_the_conversation(spark):
    parts = "array<struct<kind:string,text:string,ref:string,tokens:bigint>>"
    turns = [(1, t, "assistant" if t % 2 else "user", [("text", f"turn {t} ", None, None), ("image", None, f"i{t}.png", 10)]) for t in range(600)]
    df = spark.createDataFrame(turns + [(None, 0, None, [("audio", None, "a", 1)])], f"conv_id long, turn long, role string, parts {parts}").withColumn("_said", F.lit(1)).withColumn("spans", F.lit(2)).repartition(4)
    r = next(x for x in chat.format_conversations(df).collect() if x.conv_id == 1)
    assert [tuple(a) for a in r.attachments] == [(t + 1, t + 1, 1, "image", f"i{t}.png", 10) for t in range(600)]
    assert [(r.formatted[x.start : x.end], x.turn) for x in r.spans] == [(f"turn {t} <|image:1|>", t + 1) for t in range(1, 600, 2)]


def test_chat_links_become_parts(spark):
    texts = ["see https://a.it/x.png and HTTP://b.it/y.PDF.", "https://a.it/x.pngs http://c.it/", "https://a.it/1.wav", "a < b https://a.it/&<x.jpg", None, "two https://a.it/1.gif https://a.it/2.gif", "<|image:1|> http://q.it/z.jpg"]
    data = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    r = next(x for x in chat.conversation_digests(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect() if x.conv_id == 1)
    whole = "".join(f"{role}\n{t or ''}\n" for _, _, role, t in data)
    assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    loss = "".join(t or "" for _, _, role, t in data if role == "assistant")
    assert (r.loss_sha256, r.loss_chars) == (hashlib.sha256(loss.encode()).hexdigest(), len(loss))
    kinds = ["image", "document", "audio", "image", "image", "image"]
    assert (r.n_attachments, r.expanded_tokens) == (6, sum(chat.EXPANDED[k] for k in kinds))


# 7


def plain_ppm(train, text, order=3):
    """Code length by dictionaries: escape method C with exclusion, the alphabet of all languages plus one class for the rest."""
    alphabet = {0} | {b for ts in train.values() for t in ts for b in t.lower()}
    size, out = len(alphabet) + 1, {}
    symbol = lambda b: b if b in alphabet else -1
    for lang, texts in train.items():
        seen = defaultdict(Counter)
        stream = [symbol(b) for b in b"\0" * order + (b"\0" * order).join(t.lower() for t in texts)]
        for k in range(order + 1):
            for i in range(k, len(stream)):
                seen[k, tuple(stream[i - k : i])][stream[i]] += 1

        def p(context, sym, seen=seen):
            if context is None:
                return 1 / size
            counts = seen.get((len(context), context))
            shorter = context[1:] if context else None
            if counts is None:
                return p(shorter, sym)
            total, kinds = sum(counts.values()), len(counts)
            rest = 1 - sum(p(shorter, x) for x in counts)
            if rest <= 1e-9:
                return counts[sym] / total
            return counts[sym] / (total + kinds) if sym in counts else kinds / (total + kinds) * p(shorter, sym) / rest

        s = [symbol(b) for b in b"\0" * order + text.lower()]
        out[lang] = -sum(np.log2(p(tuple(s[i - order : i]), s[i])) for i in range(order, len(s)))
    return out


def test_language_model():
    rng = random.Random(1)
    texts = {"a": [prose(rng, 30).encode() for _ in range(4)], "b": [prose(rng, 30).replace("t", "q").encode() for _ in range(4)], "c": ["жшщ жж".encode()]}
    m = langid.ContextTrees(texts)
    odd = [texts["a"][0], b"The zzz 99!", "щшж".encode(), b"q" * 9, b"\xff\x00A"]
    got = m.lengths(odd)
    for t, row in zip(odd, got, strict=True):
        want = plain_ppm(texts, t)
        assert np.allclose(row, [want[x] for x in m.langs], rtol=1e-4), t
    long = texts["a"][0] * 40
    assert np.allclose(m.lengths([long], block=1000), m.lengths([long]))
    alone = [langid.ContextTrees({x: texts[x]}, alphabet=b"".join(b"".join(t) for t in texts.values())) for x in "abc"]
    assert np.allclose(np.concatenate([x.lengths(odd) for x in alone], 1), got, rtol=1e-4)  # languages don't touch each other


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.document_languages(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    odd = spark.createDataFrame([(1, None, "en", "a", 0), (2, "123 ...", "en", "a", 0), (3, "", None, "a", 0)], SCHEMA)
    long = d.where("lang = 'en' and text is not null").orderBy("doc_id").limit(1)
    twice = long.selectExpr("-1L as doc_id", "repeat(text || ' ', 3000) as text", "lang", "source", "n_chars")
    judged = langid.document_languages(d.unionByName(twice).unionByName(twice)).where("doc_id = -1").collect()
    assert [r.lang_pred for r in judged] == ["en"] * 2
    assert [r.lang_pred for r in langid.document_languages(odd.unionByName(d)).where("doc_id in (1, 2, 3)").collect()].count("und") >= 3
    assert langid.document_languages(empty(spark)).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    made = {f"l{n:02}": [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60)) for _ in range(3)] for n in range(70) for letters in ["".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6))]}
    made["copies"] = ["\u03b1\u03b2\u03b3 " * 40] * 700 + ["\u03b2\u03b1\u03b1 " * 40] * 700
    made["long"] = ["\u0436\u0448\u0449 " * 6000]
    rows = [(lang, t) for lang, texts in made.items() for t in texts]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    one = [(lang, texts[0]) for lang, texts in made.items()]
    asked = spark.createDataFrame(one, "lang string, text string").withColumn("_Score", F.lit("mine"))
    whole = langid.identify(asked, "text", langid.learn(labelled)).orderBy("lang").collect()
    assert whole[0]._Score_given == "mine"
    assert all(r.lang == r._lang for r in whole)
    trees = list(langid.learn(labelled, tree_bytes=1_000_000))
    assert len(trees) > 4 and all(t.bytes <= 1_000_000 for t in trees)
    parts = langid.identify(asked, "text", iter(trees)).orderBy("lang").collect()
    assert [(r.lang, r._lang) for r in parts] == [(r.lang, r._lang) for r in whole]
    assert np.allclose([r._score for r in parts], [r._score for r in whole])


def test_language_sample_is_bounded(spark):
    rows = [("a", f"text {i % 50}") for i in range(400)] + [("b", "one")] * 300 + [("c", "\u0436" * 40_000)]
    labelled = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    got = langid.sampled(labelled, rows=5, most_bytes=1000).collect()
    hashes = {r[0] for r in labelled.where("lang = 'a'").select(F.xxhash64("text")).distinct().collect()}
    assert {r._h for r in got if r.lang == "a"} == set(sorted(hashes)[:5])
    assert sorted(Counter(r.lang for r in got).items()) == [("a", 5), ("b", 1), ("c", 1)]
    assert all(len(r.text.encode()) <= 1000 for r in got)
    trees = list(langid.learn(labelled, rows=5, tree_bytes=1))
    assert [t.langs for t in trees] == [["a"], ["b"], ["c"]]


# 8


def brute_fingerprint(text, width=4):
    w = lower(text or "").encode().split()
    s = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, near):
    ids, f = [i for i, _ in prints], [x for _, x in prints]
    label = list(range(len(f)))
    changed = True
    while changed:
        changed = False
        for i in range(len(f)):
            for j in range(len(f)):
                if bin(f[i] ^ f[j]).count("1") <= near and label[j] < label[i]:
                    label[i], changed = label[j], True
    least = {}
    for i, x in zip(ids, label, strict=True):
        least[x] = min((v for v in (least.get(x), i) if v is not None), default=None)
    return [least[x] for x in label]


def test_simhash(spark, docs):
    data = rows()
    prints = [(r[0], brute_fingerprint(r[1])) for r in data]
    want = Counter((i, f"{f:016x}", c) for (i, f), c in zip(prints, brute_components(prints, 4), strict=True))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.document_components(docs).collect())
    assert got == want
    assert simhash.document_components(empty(spark)).count() == 0
    clash = simhash.near_duplicates(docs.selectExpr("doc_id as _id", "text as _text", "doc_id as _Of", "1 as _F0"), 4, 2, 4)
    assert set(clash.columns) == {"_id", "_Of_given", "_F0_given", "_f0", "_component"} and clash.where("_Of_given <> _id").count() == 0


@pytest.mark.parametrize(("segments", "near", "bucket"), [(2, 4, 8192), (2, 4, 8), (4, 11, 16)])
def test_links_join_what_pairs_join(spark, segments, near, bucket):
    rng = random.Random(segments + near)
    f = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        x = rng.choice(f)
        for b in rng.sample(range(64), rng.randint(1, near)):
            x ^= 1 << b
        f.append(x)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in f})
    df = spark.createDataFrame([(x,) for x in signed], "_f0 long")
    got = {r.node: r.label for r in simhash.components(simhash.links(df, segments, near, bucket)).collect()}
    want = brute_components([(x, x & (1 << 64) - 1) for x in signed], near)
    assert {x: got.get(x, x) for x in signed} == dict(zip(signed, want, strict=True))


def test_distinct_rows(spark, docs):
    kept = simhash.distinct_rows(docs).collect()
    texts = [r.text for r in kept]
    assert len({t for t in texts if t and t.strip()}) == len([t for t in texts if t and t.strip()])
    assert sum(t is not None and "changed" in t for t in texts) <= 1
    assert simhash.distinct_rows(docs).columns == docs.columns


@pytest.mark.parametrize(("few", "block"), [(64, 1024), (2, 1024), (2, 6)])
def test_distinct_rows_against_all_pairs(spark, few, block, monkeypatch):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (few, block))
    rng, data = random.Random(8), []
    for g in range(60):  # half of the changed copies are a little above similarity 0.8, half a little below
        base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        data.append((len(data), " ".join(base)))
        for k in (6, 8) if g else (5, 6, 7, 8) * 5:
            copy = list(base)
            for at in range(k):
                copy[at * 30 + 5] = f"x{rng.randrange(10**6)}"
            data.append((len(data), " ".join(copy)))
    data += [(None, "no id one two three"), (None, "No id one two  three"), (len(data), None)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for _, t in data)]
    label, changed = list(range(len(data))), True
    near = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(sets[i] != sets[j] for i, j in near) > 60
    while changed:
        changed = False
        for i, j in near:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    got = simhash.distinct_rows(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in data], SCHEMA)).collect()
    want = {min((data[i][0] for i in range(len(data)) if label[i] == x and data[i][0] is not None), default=None) for x in set(label)}
    assert len(got) == len(set(label)) and {r.doc_id for r in got} == want


def planted(rng, size, pairs):
    """Pairs of shingle sets at similarity 0.8 (or just above, where sizes allow no 0.8)."""
    out = []
    for _ in range(pairs):
        common = [rng.getrandbits(64) for _ in range(size - size // 9)]
        more = [rng.getrandbits(64) for _ in range(2 * (size // 9) or 1)]
        half = (len(more) + 1) // 2
        out.append([np.array(common + x, np.uint64) for x in (more[:half], more[half:])])
    return out


@pytest.mark.parametrize("size", [4, 5, 9, 18, 180])
def test_long_fingerprints_share_a_segment(size):
    for x, y in planted(random.Random(size), size, 400):
        assert len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
        f, g = (np.frombuffer(simhash.long_fingerprint(s), np.uint16) for s in (x, y))
        n = min(len(f), len(g))
        assert (f[:n] == g[:n]).any() and np.bitwise_count(f[: 4 * simhash.HEAD] ^ g[: 4 * simhash.HEAD]).sum() <= simhash.FAR


@pytest.mark.parametrize(("few", "bucket"), [(64, 8192), (2, 8192), (2, 5)])
def test_candidates_are_those_of_the_multi_index(spark, few, bucket):
    """The stage's pairs come from SimHash segments: all that share one, with near heads and different labels, and no others."""
    rng = random.Random(few)
    sets = [s for size in (4, 30) for pair in planted(rng, size, 30) for s in pair]
    sets += [np.append(sets[-1], np.uint64(rng.getrandbits(64))) for _ in range(12)]
    prints = [simhash.long_fingerprint(s) for s in sets]
    assert len(prints[0]) == 4 * simhash.SEGMENTS and len(prints[-1]) == 2 * simhash.SEGMENTS
    label = [i - i % 2 if i < 8 else i for i in range(len(sets))]

    def want(a, b):
        f, g = ([int.from_bytes(prints[i][k : k + 2], "little") for k in range(0, len(prints[i]), 2)] for i in (a, b))
        far = sum(bin(x ^ y).count("1") for x, y in zip(f[:12], g[:12], strict=True))
        return label[a] != label[b] and far <= 53 and any(x == y for x, y in zip(f, g, strict=False))

    nodes = spark.createDataFrame([(i, label[i], bytes(p)) for i, p in enumerate(prints)], "node long, label long, _print binary")
    pairs, hot = simhash.candidates(nodes, 0, 2 * simhash.SEGMENTS, False, few, bucket)
    got, groups = {tuple(r) for r in pairs.collect()}, {}
    for r in hot.collect():
        groups.setdefault(r.key, []).append(r.node)
    brute = {(a, b) for b in range(len(sets)) for a in range(b) if want(a, b)}
    met = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert got <= brute <= got | met and len(brute) > 80 and bool(groups) == (few == 2)


@pytest.mark.parametrize("bucket", [8192, 20])
def test_crowded_pairs_meet_in_their_first_segment(spark, bucket):
    """Rounds over the head's segments and the others find every pair that may be similar, crowded ones in one bucket only."""
    rng = random.Random(bucket)
    base = [rng.getrandbits(64) for _ in range(150)]
    sets = [np.array(base[:k] + [rng.getrandbits(64) for _ in range(150 - k)], np.uint64) for k in (90, 110, 130, 140) * 15]
    sets += [s for size in (4, 5, 9) for pair in planted(rng, size, 10) for s in pair]
    prints = [simhash.long_fingerprint(s) for s in sets]
    rows = [(i, i, bytes(p), i % 7 > 0) for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node long, label long, _print binary, _crowded boolean").repartition(3)
    met, times = set(), Counter()
    for first, last in simhash.ROUNDS[simhash.FULL :]:
        pairs, hot = simhash.candidates(nodes if first else nodes.drop("_crowded"), first, last, False, 10**6, bucket)
        assert hot.isEmpty()
        times.update(tuple(r) for r in pairs.collect())
    for b, a in ((b, a) for b in range(len(sets)) for a in range(b)):
        f, g = (np.frombuffer(prints[i], np.uint16) for i in (a, b))
        n = min(len(f), len(g))
        differ, full = f[:n] ^ g[:n], len(f) == len(g) == simhash.SEGMENTS and rows[a][3] and rows[b][3]
        near = (differ == 0).any() and np.bitwise_count(differ[:12]).sum() <= simhash.FAR
        shared = np.flatnonzero(differ == 0)
        if (shared < 12).any() or full:
            assert times[a, b] <= 1
        if near and (shared[0] < 12 or not full or np.bitwise_count(differ).sum() <= simhash.ALIKE):
            met.add((a, b))
        if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])):
            assert (a, b) in met
    assert set(times) == met and len(met) > 300


# 9


def brute_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    rep = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    marks = sum(c in string.punctuation for c in text)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), sum(bool(re.search(r"[#*$%&|<>]", x)) for x in w), sum(len(x) ** 2 for x in w), marks


def test_quality_statistics():
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choices(["a ", "b ", "\n", "#", "é", " ", "x\n", " ", "<", "a b c d e ", "\r", "\x0b"], k=rng.randint(0, 60)))
        assert quality.text_stats(t.encode()) == brute_stats(t), repr(t)
    many = " ".join(str(i % 9000) for i in range(18_010))
    assert quality.text_stats(many.encode()) == brute_stats(many)


def test_quality_query(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.document_quality(d, labels)
    j = got.join(labels, "doc_id").where("not base_failed")
    good, lost = j.where("quality = 1").count(), j.where("quality = 1 and not kept").count()
    bad, found = j.where("quality = 0").count(), j.where("quality = 0 and not kept").count()
    assert lost <= 0.01 * good and found >= 0.8 * bad
    assert got.exceptAll(quality.document_quality(d, labels)).count() == 0
    assert quality.document_quality(empty(spark), labels).count() == 0
    assert quality.document_quality(d, labels.limit(0)).where("kept = base_failed").count() == 0
    kept = quality.kept_rows(d.withColumn("_n_words", d.doc_id), labels)
    assert kept.columns == [*d.columns, "_n_words"] and kept.where("_n_words <> doc_id").count() == 0
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got.where("kept").collect()}


def test_quality_edge_rows(spark):
    text = "some words that make a text of ten or more words in all"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, text * 3000), (5, "x " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (None, 1)], "doc_id long, quality int")
    got = quality.document_quality(docs, labels).collect()
    assert len(got) == len(rows) and [r.base_failed for r in sorted(got, key=lambda r: (r.doc_id or 0, r.n_words))] == [False, True, True, False, False, True, True]
    assert len({r.score for r in got if r.n_words == 13}) == 1


def test_quality_on_held_out_labels(spark):
    """Half of the labels set the threshold, the other half judges it; the trees see none."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    j = quality.document_quality(d, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    n = {(r.quality, r.kept): r["count"] for r in j.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.05 * (n.get((1, False), 0) + n[1, True])
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


def plain_path(tree, x, node=0):
    feature, cut, left, path = tree
    if feature[node] < 0:
        return path[node]
    return plain_path(tree, x, left[node] + (0 if x[feature[node]] <= cut[node] else 1))


def plain_leaves(tree, points, node=0, depth=0):
    """Checks that each leaf's path is its depth plus the mean path of a search among the points that end there.

    Harmonic numbers are estimated by the logarithm and Euler's constant, as in the published method.
    """
    feature, cut, left, path = tree
    if feature[node] < 0:
        n = len(points)
        assert abs(path[node] - depth - (0 if n <= 1 else 1 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n)) < 1e-9
        return
    below = [p for p in points if p[feature[node]] <= cut[node]]
    assert 0 < len(below) < len(points)
    plain_leaves(tree, below, left[node], depth + 1)
    plain_leaves(tree, [p for p in points if p[feature[node]] > cut[node]], left[node] + 1, depth + 1)


def test_forest_against_plain_walk():
    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 3))
    forest = quality.IsolationForest(points, trees=7, subsample=60)
    for tree in forest.trees:
        plain_leaves(tree, points.tolist())
    c = 2 * (np.log(59) + 0.5772156649) - 2 * 59 / 60
    want = [2 ** -(np.mean([plain_path(t, x) for t in forest.trees]) / c) for x in points]
    assert np.allclose(forest.scores(points), want)


def test_forest_finds_rare_rows():
    rng = np.random.default_rng(5)
    usual = np.stack([rng.normal(5, 0.3, 950), rng.normal(1, 0.2, 950)], 1)
    rare = np.stack([rng.normal(5, 0.3, 50), rng.uniform(4, 9, 50)], 1)
    forest = quality.IsolationForest(np.concatenate([usual, rare]))
    assert np.quantile(forest.scores(usual), 0.98) < np.quantile(forest.scores(rare), 0.1)
    assert (quality.IsolationForest(usual[:0]).scores(rare) == 0).all()
    assert len(set(quality.IsolationForest(usual[:1].repeat(9, 0)).scores(usual[:3]))) == 1


# 10


def test_mixing(spark, docs):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows())
    size, target, taken, own = Counter(), {}, Counter(), defaultdict(list)
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        own[r.source].append(r.size)
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    want, left, free = {}, 1.5 * sum(size.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] >= 2 * size[s]}
        want |= {s: 2 * size[s] if s in full else level * weight[s] for s in full or free}
        left -= sum(2 * size[s] for s in full)
        free = free - full if full else set()
    assert all(abs(want[s] - target[s]) < 1e-6 for s in names)
    assert all(abs(taken[s] - target[s]) <= max(own[s]) for s in names)
    assert Counter(map(tuple, mixing.mix_documents(docs).collect())) == Counter(map(tuple, got))
    assert mixing.mix_documents(empty(spark)).count() == 0
    twice = docs.unionByName(docs.where("doc_id = 903")).withColumn("_copies", docs.doc_id)
    mixed = mixing.mix_rows(twice)
    copies, want = Counter((r.doc_id, r.text) for r in mixed.collect()), Counter()
    for r in mixing.mix_documents(twice).collect():
        want[r.doc_id] += r.copies
    got = Counter()
    for (i, _), n in copies.items():
        got[i] += n
    assert mixed.columns == twice.columns and got == +want


def test_pivotal_tree(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 's', 't') as source", "id as pos", "0.3D as p", "cast(1 + id % 7 as double) as size")
    got = mixing.pivotal_rounding(df, fan_in=8)
    j = got.join(df, "pos")
    assert j.count() == 5000 and got.select("pos").distinct().count() == 5000
    for r in j.selectExpr("source", "one * size as t", "p * size as e").groupBy("source").sum("t", "e").collect():
        assert abs(r["sum(t)"] - r["sum(e)"]) <= 7


def test_automaton_is_small():
    """Ten thousand items share a passage: its windows are held by all, and each set of holders is kept once."""
    rng = random.Random(8)
    shared = [f"s{k}".encode() for k in range(30)]
    items = [(str(i), [*shared, *(f"w{rng.randrange(5000)}".encode() for _ in range(20))]) for i in range(10_000)]
    a = decontam.SuffixAutomaton(items, 10)
    flat = sum(len(x) * x.itemsize for x in (a.symbol, a.target, a.link, a.length, a.windows, a.short, a.keys, a.to, *a.sets))
    assert flat < 60 * 500_000 and len(a.sets) < 220_000
    spans, sets = a.hits([b"x", *shared, *items[7][1][30:]])
    assert spans == [(1, 51)] and a.names(sets) == {i for i, _ in items} and len(sets) < 60


def test_token_counts_refuse_other_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    config = Tokenizer.from_file(public_tokenizers.path(tokencount.VOCABULARY)).to_str()
    assert tokencount.word_pattern(config).findall("don't 12") == ["don", "'t", "1", "2"]
    for a, b in (('"</w>"', '"@@"'), ('"Lowercase"', '"NFKC"'), ('"ByteLevel"', '"Whitespace"')):
        with pytest.raises(ValueError):
            tokencount.word_pattern(config.replace(a, b))
    rows = spark.createDataFrame([("a b", 1), ("a b", 1), (None, 2)], "text string, _N_Bytes int")
    got = tokencount.count_tokens(rows, "text", public_tokenizers.path(tokencount.VOCABULARY))
    assert sorted(got.columns) == ["_N_Bytes_given", "_n_bytes", "_n_tokens"] and got.count() == 3
    assert tokencount.document_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_quality_bar_and_threshold():
    assert quality.hash_bar(10, 10) == 2**63 - 1
    for n in (10**5, 10**11, 10**17):
        share = (quality.hash_bar(20_000, n) + 2**63) / 2**64
        assert 0.99 < share * n / 20_000 < 1.01
    good, bad = {300: 980, 500: 15, 700: 4, 800: 1}, {500: 3, 700: 40, 800: 7}
    assert quality.threshold(good, bad) == 700  # 500 would lose two per cent
    assert quality.threshold(good, {}) == 501 and quality.threshold({}, bad) == quality.BINS + 1
    assert quality.threshold({300: 1000}, {600: 5}) == 600  # no good row is lost for nothing
