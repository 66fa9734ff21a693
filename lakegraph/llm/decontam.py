"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton takes in every item word by word; a document's words are streamed through it while the longest matching
length is tracked. A match of the window's length marks the words of the window as hit. Automata are built in Spark
tasks, one for each bounded block of items, and are kept in flat arrays.
"""

from __future__ import annotations

import re
import uuid
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.common import map_texts, set_aside, written

WINDOW = 10
#: UTF-8 bytes of item texts in one automaton, about; a larger benchmark is taken in several passes over the documents.
BLOCK_BYTES = 8 << 20
#: A document that loses more than this share of its words is dropped as a whole by ``cleaned_rows``.
COVERAGE = 0.5
#: Words of lower-cased UTF-8 text.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text: bytes | None) -> list[bytes]:
    return WORD.findall((text or b"").lower())


class _Builder:
    """A growing automaton. A state's first transition lies in two arrays; only states that branch have a dict for the others."""

    def __init__(self):
        self.symbol, self.target = array("i", [-1]), array("i", [-1])
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}

    def get(self, state: int, c: int) -> int:
        if self.symbol[state] == c:
            return self.target[state]
        others = self.more.get(state)
        return -1 if others is None else others.get(c, -1)

    def put(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to

    def state(self, length: int, link: int) -> int:
        self.symbol.append(-1)
        self.target.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def extend(self, last: int, c: int) -> int:
        """State of the sequence so far plus word ``c``."""
        link, length = self.link, self.length
        known = self.get(last, c)
        if known >= 0:
            return known if length[known] == length[last] + 1 else self.split(last, c, known)
        new = self.state(length[last] + 1, 0)
        p, q = last, -1
        while p >= 0 and (q := self.get(p, c)) < 0:
            self.put(p, c, new)
            p = link[p]
        if p >= 0:
            link[new] = q if length[q] == length[p] + 1 else self.split(p, c, q)
        return new

    def split(self, p: int, c: int, q: int) -> int:
        """The state of the strings of ``q`` that are no longer than those of ``p`` plus ``c``."""
        copy = self.state(self.length[p] + 1, self.link[q])
        self.symbol[copy], self.target[copy] = self.symbol[q], self.target[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self.get(p, c) == q:
            self.put(p, c, copy)
            p = self.link[p]
        return copy


class SuffixAutomaton:
    """States of all substrings of several word sequences, in flat arrays.

    A state's transitions: the first in ``symbol`` and ``target``, others in ``keys`` (state times vocabulary plus word,
    sorted) and ``to``. ``sets`` are the distinct lists of items (numbers into ``items``) that some state has: ``windows``
    has the list of the items that hold the window ending in a state, or -1. ``short`` has the nearest state on the suffix
    path, itself included, where whole items below the window's length end; ``ends`` lists (length, set) of such states.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window, self.items = window, [item for item, _ in items]
        self.vocab: dict[bytes, int] = {}
        b, paths = _Builder(), []
        for _, words in items:
            ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in words])
            last = 0
            for c in ids:
                last = b.extend(last, c)
            paths.append(ids)
        n, v = len(b.length), max(1, len(self.vocab))
        order = np.argsort(np.frombuffer(b.length, np.int32), kind="stable")[1:].tolist()
        at = array("i", [-1]) * n  # the state on the suffix path that holds the string of the window's length
        for s in order:
            up = b.link[s]
            at[s] = s if b.length[up] < window <= b.length[s] else at[up]
        held: dict[int, array] = {}
        whole: dict[int, dict[int, array]] = {}
        for item, ids in enumerate(paths):
            s = 0
            for c in ids:
                s = b.get(s, c)
                if at[s] >= 0:
                    own = held.setdefault(at[s], array("i"))
                    if not own or own[-1] != item:
                        own.append(item)
            if 0 < len(ids) < window:
                whole.setdefault(s, {}).setdefault(len(ids), array("i")).append(item)
        names: dict[bytes, int] = {}
        self.sets: list[array] = []

        def named(members: array) -> int:
            k = names.setdefault(members.tobytes(), len(names))
            if k == len(self.sets):
                self.sets.append(members)
            return k

        own = {s: named(x) for s, x in held.items()}
        self.windows = array("i", (own.get(a, -1) for a in at))
        self.ends = {s: [(m, named(x)) for m, x in sorted(found.items())] for s, found in whole.items()}
        self.short = array("i", [-1]) * n
        for s in order:
            self.short[s] = s if s in self.ends else self.short[b.link[s]]
        self.symbol, self.target, self.link, self.length = b.symbol, b.target, b.link, b.length
        keys, to = array("q"), array("i")
        while b.more:
            s, found = b.more.popitem()
            keys.extend(s * v + c for c in found)
            to.extend(found.values())
        rank = np.argsort(np.frombuffer(keys, np.int64)) if keys else np.zeros(0, int)
        self.keys, self.to = (array(x.typecode, np.frombuffer(x, x.typecode)[rank].tobytes() if x else b"") for x in (keys, to))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged spans of hit words (end exclusive), and the numbers of the sets of items with occurring windows."""
        symbol, target, link, length, keys, to = self.symbol, self.target, self.link, self.length, self.keys, self.to
        windows, short, ends, window, v, m_keys = self.windows, self.short, self.ends, self.window, max(1, len(self.vocab)), len(self.keys)
        get = self.vocab.get
        spans: list[tuple[int, int]] = []
        sets: set[int] = set()
        s = n = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                s = n = 0
                continue
            while True:
                if symbol[s] == c:
                    s, n = target[s], n + 1
                    break
                k = s * v + c
                x = bisect_left(keys, k)
                if x < m_keys and keys[x] == k:
                    s, n = to[x], n + 1
                    break
                if not s:
                    n = 0
                    break
                s = link[s]
                n = length[s]
            low = i + 1
            if n >= window:
                low = i + 1 - window
                sets.add(windows[s])
            e = short[s] if n else -1
            while e >= 0:
                for m, own in ends[e]:
                    if m <= n:
                        low = min(low, i + 1 - m)
                        sets.add(own)
                e = short[link[e]]
            if low <= i:
                while spans and spans[-1][1] >= low:
                    low = min(low, spans.pop()[0])
                spans.append((low, i + 1))
        return spans, sets

    def names(self, sets: set[int]) -> set[str | None]:
        """Ids of the items in some sets; each set is looked at once for a document."""
        return {self.items[x] for k in sets for x in self.sets[k]}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def build_automata(items: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """``block, automaton`` (pickled): items are dealt by hash into blocks of about ``block_bytes``, each built in one task.

    Items of equal id and text count once; items without words are left out. One item is never divided.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def build(table: pa.Table) -> pa.Table:
        import pickle

        order = table.sort_by([("item", "ascending"), ("text", "ascending")])
        found = [(i, w) for i, t in zip(order["item"].to_pylist(), order["text"].to_pylist(), strict=True) if (w := words_of(t.encode()))]
        return pa.table({"block": order["block"][:1], "automaton": [pickle.dumps(SuffixAutomaton(found, window))]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(build, "block long, automaton binary")


_LOADED: dict[str, SuffixAutomaton] = {}


def _automaton(token: str, shared) -> SuffixAutomaton:
    """One automaton in each Python worker, kept for the worker's next tasks."""
    if token not in _LOADED:
        import pickle

        _LOADED.clear()
        _LOADED[token] = pickle.loads(shared.value)
    return _LOADED[token]


FOUND = "_n_words long, _starts array<int>, _ends array<int>, _items array<string>"


def find_hits(docs: DataFrame, text: str, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Adds ``_n_words``, ``_starts``, ``_ends`` (spans of hit words, merged) and ``_items`` (ids as strings, sorted) to the documents.

    With ``clean``, ``text`` is replaced by the text without the hit words. Null and empty texts have no words; an empty
    benchmark hits nothing; repeated items and repeated documents are no special case. Items without an id mark words like
    others and are one null, last, in ``_items``. Each block of the benchmark is one pass over the documents, whose result
    is written before the next; the driver holds one block's automaton at a time. A caller's column with an output
    column's name goes on under its name and ``_given``.
    """
    automata = written(build_automata(items, window, block_bytes), "automata")
    names = sorted(r.block for r in automata.select("block").collect()) or [None]
    docs = set_aside(docs, FOUND + ", _scan string")
    for n, block in enumerate(names):
        packed = automata.where(F.col("block") == block).first().automaton if block is not None else _nothing(window)
        docs = _pass(written(docs, "hits") if n else docs, text, packed, not n, clean and n == len(names) - 1)
    return docs


def _nothing(window: int) -> bytes:
    import pickle

    return pickle.dumps(SuffixAutomaton([], window))


def _pass(docs: DataFrame, text: str, packed: bytes, first: bool, clean: bool) -> DataFrame:
    shared, token = docs.sparkSession.sparkContext.broadcast(packed), uuid.uuid4().hex

    def make(texts: list[bytes | None], *before: list) -> dict[str, list]:
        automaton = _automaton(token, shared)
        out: dict[str, list] = {"_n_words": [], "_starts": [], "_ends": [], "_items": [], text: []}
        for i, t in enumerate(texts):
            words = words_of(t)
            spans, sets = automaton.hits(words)
            found = automaton.names(sets)
            if before:
                starts, ends, known = (b[i] for b in before)
                spans, found = merged([*spans, *zip(starts, ends, strict=True)]), found.union(known)
            out["_n_words"].append(len(words))
            out["_starts"].append([a for a, _ in spans])
            out["_ends"].append([b for _, b in spans])
            out["_items"].append(sorted(x for x in found if x is not None) + [None] * (None in found))
            if clean:
                out[text].append(t if t is None else cut(t, spans).decode())
        return out

    also = [] if first else ["_starts", "_ends", "_items"]
    docs = docs if first else docs.drop("_n_words")
    if clean:
        return map_texts(docs, text, f"{FOUND}, {text} string", make, also)
    return map_texts(docs.withColumn("_scan", F.col(text)), "_scan", FOUND, make, also)


def n_hit() -> Column:
    """Hit words: the spans don't overlap."""
    return F.aggregate(F.zip_with("_starts", "_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def document_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The query's digest."""
    found = find_hits(docs.select("doc_id", "text"), "text", items, window).drop("text")
    sha = F.sha2(F.array_join("_items", ","), 256)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        sha.alias("items_sha256"), (n_hit() > 0).alias("contaminated"),
    )


def cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the hit words; a run of them goes with what stands between its words."""
    if not spans:
        return raw
    at = [m.span() for m in WORD.finditer(raw.lower())]
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]])


def cleaned_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Whole documents without the spans that occur in the benchmark, with the columns they came with.

    A document that loses more than ``coverage`` of its words is dropped; one without words or hits stays as it is.
    ``n_chars``, where the table has it, follows the text of a document that was cut. Null texts stay null, repeated rows are
    cut alike, an empty table stays empty, and columns may have any names.
    """
    packed = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text"))
    stay = find_hits(packed, "_text", items, window, clean=True).where(n_hit() <= F.col("_n_words") * F.lit(coverage))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("_starts") > 0, F.length("_text")).otherwise(F.col("_doc.n_chars"))
    return stay.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns))
