"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts up to three bytes, with frozen counts. The probability of a byte is its share
in the longest known context, or the context's escape probability times its probability in the next shorter one, among
the bytes that the longer one has not seen. A text's code length under a language is the sum over all its bytes; the
shortest code wins.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.llm.common import map_texts, set_aside, utf8_bytes, written

ORDER = 3
#: Labelled texts for each language that the trees are grown on, at most; they are chosen by the hash of the text.
SAMPLE_ROWS = 300
#: Longest piece of a text (UTF-8 bytes) in that sample.
SAMPLE_BYTES = 32_768
#: Bytes of the trees that are broadcast at once; a block of languages with larger trees is divided.
MOST_BYTES = 128 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


Levels = list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


class ContextTrees:
    """Code lengths (bits) of bytes after their contexts, for each language; only what was seen is stored.

    Bytes are reduced to the ``alphabet`` plus one class for the rest; A-Z count as a-z. For each order ``k`` the sorted
    ``keys[k]`` are the codes (``k`` symbols of context and the next) that some language has seen, ``bits[k]`` has a length
    for each language; ``contexts[k]`` and ``escapes[k]`` are the same for what it costs to leave a context for the next
    shorter one. Lengths of several trees can be compared if all have the same ``alphabet``.
    """

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER, alphabet: bytes = b""):
        seen = b"".join(t for some in texts.values() for t in some)
        self._take_alphabet(seen + alphabet, order)
        self._merge({lang: self.levels(some) for lang, some in texts.items()})

    @classmethod
    def merged(cls, levels: dict[str, Levels], alphabet: bytes, order: int = ORDER) -> ContextTrees:
        """Trees of several languages from what ``levels`` made of each."""
        trees = cls({}, order, alphabet)
        trees._merge(levels)
        return trees

    def _take_alphabet(self, seen: bytes, order: int) -> None:
        known = np.unique(np.frombuffer(b"\0" + seen.lower(), np.uint8))
        self.order, self.size = order, len(known) + 1
        self.symbol = np.full(256, self.size - 1, np.int64)
        self.symbol[known] = np.arange(len(known))
        self.symbol[65:91] = self.symbol[97:123]

    def levels(self, texts: list[bytes]) -> Levels:
        """One language: for each order its keys, their lengths, its contexts and their escape lengths."""
        pad = b"\0" * self.order
        return self._counted(self.symbol[np.frombuffer(pad + pad.join(texts), np.uint8)])

    def _merge(self, levels: dict[str, Levels]) -> None:
        self.langs, a = sorted(levels), self.size
        own = [levels[lang] for lang in self.langs]
        self.keys, self.bits, self.contexts, self.escapes = [], [], [], []
        none = np.zeros(0, np.int64)
        for k in range(self.order + 1):
            keys = np.unique(np.concatenate([x[k][0] for x in own])) if own else none
            contexts = np.unique(keys // a)
            bits, escapes = np.zeros((len(keys), len(own)), np.float32), np.zeros((len(contexts), len(own)), np.float32)
            up = np.searchsorted(self.keys[k - 1], keys % a**k) if k else none
            for n, known_levels in enumerate(own):
                mine, length, known, escape = known_levels[k]
                escapes[np.searchsorted(contexts, known), n] = escape
                below = self.bits[k - 1][up, n] if k else np.float32(np.log2(a))
                bits[:, n] = below + escapes[np.searchsorted(contexts, keys // a), n]
                bits[np.searchsorted(keys, mine), n] = length
            self.keys.append(keys)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    def _counted(self, s: np.ndarray) -> Levels:
        a, out = self.size, []
        for k in range(self.order + 1):
            code = self._codes(s, k + 1)
            keys, counts = np.unique(code, return_counts=True)
            if not len(keys):
                out.append((keys, np.zeros(0), keys, np.zeros(0)))
                continue
            contexts, first, kinds = np.unique(keys // a, return_index=True, return_counts=True)
            total = np.add.reduceat(counts, first)
            lower = 2.0 ** -out[k - 1][1][np.searchsorted(out[k - 1][0], keys % a**k)] if k else np.full(len(keys), 1.0 / a)
            rest = 1.0 - np.add.reduceat(lower, first)
            full = (rest <= 1e-9) | (kinds == a)
            at = np.repeat(np.arange(len(contexts)), kinds)
            share = counts / np.where(full, total, total + kinds)[at]
            escape = kinds / (total + kinds) / np.where(full, 1.0, rest)
            out.append((keys, -np.log2(share), contexts, np.where(full, 0.0, -np.log2(np.maximum(escape, 1e-30)))))
        return out

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for part in (self.keys, self.bits, self.contexts, self.escapes) for x in part)

    def _codes(self, s: np.ndarray, k: int) -> np.ndarray:
        """Code of the k symbols from each place on."""
        code = np.zeros(max(0, len(s) - k + 1), np.int64)
        for i in range(k):
            code = code * self.size + s[i : i + len(code)]
        return code

    def lengths(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        """Code length of each text under each language; texts are coded in bounded blocks, none is cut short."""
        out = np.zeros((len(texts), len(self.langs)))
        todo: list[tuple[int, bytes]] = []
        held = 0
        pad = b"\0" * self.order
        for i, t in enumerate(texts):
            for start in range(0, len(t), block):
                piece = (t[start - self.order : start] if start else pad) + t[start : start + block]
                todo.append((i, piece))
                held += len(piece)
                if held >= block:
                    self._add(todo, out)
                    todo, held = [], 0
        if todo:
            self._add(todo, out)
        return out

    def _add(self, todo: list[tuple[int, bytes]], out: np.ndarray) -> None:
        s = self.symbol[np.frombuffer(b"".join(p for _, p in todo), np.uint8)]
        code, a = self._codes(s, self.order + 1), self.size
        cost = np.zeros((len(code), len(self.langs)), np.float32)
        left = np.arange(len(code))
        for k in range(self.order, -1, -1):
            keys, contexts = self.keys[k], self.contexts[k]
            if not len(keys):
                continue
            want = code[left] % a ** (k + 1)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            cost[left[hit]] += self.bits[k][at[hit]]
            left, want = left[~hit], want[~hit] // a
            at = np.minimum(np.searchsorted(contexts, want), len(contexts) - 1)
            known = contexts[at] == want
            cost[left[known]] += self.escapes[k][at[known]]
        cost[left] += np.float32(np.log2(a))
        ends = np.cumsum([len(p) for _, p in todo])
        start = 0
        for (i, p), end in zip(todo, ends, strict=True):
            out[i] += cost[start : end - self.order].sum(0, dtype=np.float64)
            start = end


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sampled(labelled: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``lang, _h, text``: of each language the ``rows`` distinct texts of the least hashes, or all where there are no more.

    The hashes are ranked in each task first, then among the tasks' least ones, so that a language of any size hands on
    ``rows`` hashes a task. Of a text above ``most_bytes`` a piece is taken from a place that its hash gives.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") > 0)).withColumn("_h", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    least = usable.select("lang", "_h").distinct().withColumn("_rank", rank).where(F.col("_rank") <= rows).select("lang", "_h")
    piece = most_bytes // 4
    start = F.pmod(F.xxhash64("_h"), F.greatest(F.lit(1), F.length("text") - piece + 1)).cast("int") + 1
    part = F.when(F.octet_length("text") <= most_bytes, F.col("text")).otherwise(F.substring("text", start, F.lit(piece)))
    return usable.join(written(least, "language-hashes"), ["lang", "_h"], "left_semi").select("lang", "_h", part.alias("text")).dropDuplicates(["lang", "_h"])


#: All bytes, so that languages can be counted apart and compared.
ALPHABET = bytes(range(256))
LEVELS = "lang string, size long, levels binary"


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One language's texts become its levels, in one row."""
    lang, texts = None, []
    for batch in batches:
        lang = batch.column("lang")[0].as_py() if batch.num_rows else lang
        texts += list(zip(batch.column("_h").to_pylist(), utf8_bytes(batch.column("text")), strict=True))
    levels = ContextTrees({}, alphabet=ALPHABET).levels([t for _, t in sorted(texts)])
    packed = io.BytesIO()
    np.savez(packed, *(x.astype(np.float32) if x.dtype == np.float64 else x for level in levels for x in level))
    yield pa.RecordBatch.from_pydict({"lang": [lang], "size": pa.array([sum(x.nbytes for level in levels for x in level)], pa.int64()), "levels": pa.array([packed.getvalue()], pa.binary())})


def _unpacked(levels: bytes) -> Levels:
    with np.load(io.BytesIO(levels)) as found:
        flat = [found[f"arr_{k}"] for k in range(len(found.files))]
    return [tuple(flat[k : k + 4]) for k in range(0, len(flat), 4)]


def learn(labelled: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, tree_bytes: int = MOST_BYTES) -> Iterator[ContextTrees]:
    """From ``lang, text``: trees of all languages, part by part, from a bounded sample that is the same for the same rows.

    Each language is counted by a task; the driver only merges counted languages, as many at a time as have a quarter of
    ``tree_bytes`` (or one), and halves a part whose trees would be larger than ``tree_bytes``.
    """
    grown = written(sampled(labelled, rows, most_bytes).groupBy("lang").applyInArrow(_grow, LEVELS), "language-levels")
    part, held = [], 0
    for r in grown.select("lang", "size").orderBy("lang").collect():
        if part and held + r["size"] > tree_bytes // 4:
            yield from _bounded(grown, part, tree_bytes)
            part, held = [], 0
        part.append(r["lang"])
        held += r["size"]
    if part:
        yield from _bounded(grown, part, tree_bytes)


def _bounded(grown: DataFrame, langs: list[str], most_bytes: int) -> Iterator[ContextTrees]:
    """The trees of some languages, in as many parts as keep each within ``most_bytes`` (one language is never divided)."""
    rows = grown.where(F.col("lang").isin(langs)).collect()
    trees = ContextTrees.merged({r["lang"]: _unpacked(r["levels"]) for r in rows}, ALPHABET)
    del rows
    if trees.bytes <= most_bytes or len(langs) == 1:
        yield trees
        return
    del trees
    half = len(langs) // 2
    yield from _bounded(grown, langs[:half], most_bytes)
    yield from _bounded(grown, langs[half:], most_bytes)


OUT = "_lang string, _bits double, _weight double, _judged string, _score double"


def identify(df: DataFrame, text: str, trees: Iterable[ContextTrees]) -> DataFrame:
    """Replaces ``text`` by ``_lang`` and ``_score`` (the winner's posterior probability under equal priors).

    Null and empty texts, texts without a letter, or any text where no language was learned, are ``und`` with score 0. Ties
    go to the first language; repeated rows are judged alike; an empty table stays empty. One part of the trees is in
    memory at a time; between parts the documents are written with their best so far. A caller's column with an output
    column's name goes on under its name and ``_given``.
    """
    df = set_aside(df, OUT)
    names = [c for c in df.columns if c != text]
    out = df.withColumns({"_lang": F.lit(UNKNOWN), "_bits": F.lit(float("inf")), "_weight": F.lit(0.0)})
    n = 0
    for part in trees:
        out = written(out, "languages") if n else out
        n += 1
        out = _judged(out.withColumn("_judged", F.col(text)), part)
    return out.select(*names, "_lang", F.when(F.col("_weight") > 0, 1 / F.col("_weight")).otherwise(0.0).alias("_score"))


def _judged(df: DataFrame, trees: ContextTrees) -> DataFrame:
    """Takes ``_judged`` and moves ``_lang, _bits, _weight`` on: the best language, its length, and all probabilities over its own."""
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def make(texts: list[bytes | None], lang: list[str], length: list[float], weight: list[float]) -> dict[str, list]:
        model = shared.value
        some = [i for i, t in enumerate(texts) if t and LETTER.search(t.decode())]
        bits = model.lengths([texts[i] for i in some])
        for i, row in zip(some, bits, strict=True):
            best = int(row.argmin())
            own = float(np.exp2(np.maximum(-1000, row[best] - row)).sum())
            if row[best] < length[i]:
                weight[i] = own + weight[i] * float(np.exp2(max(-1000, row[best] - length[i])))
                lang[i], length[i] = model.langs[best], float(row[best])
            else:
                weight[i] += own * float(np.exp2(max(-1000, length[i] - row[best])))
        return {"_lang": lang, "_bits": length, "_weight": weight}

    return map_texts(df, "_judged", "_lang string, _bits double, _weight double", make, ["_lang", "_bits", "_weight"])


def document_languages(docs: DataFrame) -> DataFrame:
    """The query's digest: learns from rows that are not held out, judges every row by its text alone."""
    trees = learn(docs.where(~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text"))
    out = identify(docs.select("doc_id", F.col("text").alias("_text")), "_text", trees)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
