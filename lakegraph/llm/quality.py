"""Quality rules and an isolation forest on their statistics.

Fixed rules reject what is plainly unusable. What they let pass is judged by an isolation forest: trees of random splits
over the rule statistics of a sample of all rows isolate unusual documents on short paths. Labels are not seen by the
trees; they only set the threshold. The sample is bounded; the threshold is calibrated on all labelled rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.llm.common import set_aside, text_udf, written

#: The contract's statistics, and further ones that only the forest uses.
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
MORE = "n_symbol_words long, sq_chars long, n_punct long"
NAMES = [x.split()[0] for x in f"{STATS}, {MORE}".split(", ")]
REPEAT = 5
SYMBOL = re.compile(rb"[#*$%&|<>]")
PUNCT = re.compile(rb"[!-/:-@\[-`{-~]")
TREES = 200
#: Rows of one tree: few, so that odd rows don't hide each other.
SUBSAMPLE = 128
#: Rows that the trees are grown on, at most about; a document is in the sample by the hash of its id and statistics.
SAMPLE_ROWS = 20_000
#: Share of the labelled good documents that the threshold may reject at most.
GOOD_LOSS = 0.01
#: Steps of the histogram of scores that the threshold is taken from.
BINS = 1000


def repeat_words(words: list[bytes], width: int = REPEAT) -> int:
    """Words in ``width``-word windows that occur twice or more in the text, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    code, at = ids[:n].copy(), len(known)
    for k in range(1, width):
        if at * len(known) >= 1 << 62:  # keep codes exact: rank them before they outgrow 64 bits
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            at = int(code.max()) + 1
        code = code * len(known) + ids[k : k + n]
        at *= len(known)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    same = np.zeros(n, bool)
    equal = ranked[1:] == ranked[:-1]
    same[1:] |= equal
    same[:-1] |= equal
    if not equal.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at_hit = order[same]
    np.add.at(edge, at_hit, 1)
    np.add.at(edge, at_hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """Words, code points in words, symbols, repeated lines, repeated words; words with symbols, sum of squared word
    lengths, punctuation marks of ASCII. Null counts as empty."""
    if not text:
        return (0,) * len(NAMES)
    words = text.split()
    joined = b"".join(words)
    plain = joined.isascii()
    lengths = np.fromiter(map(len, words) if plain else (len(w.decode()) for w in words), np.int64, len(words))
    symbols = len(SYMBOL.findall(joined))
    dup, seen = 0, set()
    if b"\n" in text:
        for line in text.split(b"\n"):
            if line in seen:
                dup += 1
            elif line.strip():
                seen.add(line)
    marked = sum(1 for w in words if SYMBOL.search(w)) if symbols else 0
    return len(words), int(lengths.sum()), symbols, dup, repeat_words(words), marked, int(lengths @ lengths), len(PUNCT.findall(joined))


def statistics(docs: DataFrame, text: str) -> DataFrame:
    """Replaces ``text`` by its statistics, each under its name with ``_`` before it."""

    def make(texts: list[bytes | None]) -> dict[str, list]:
        rows = [text_stats(t) for t in texts]
        return {f"_{n}": [r[i] for r in rows] for i, n in enumerate(NAMES)}

    stats = text_udf(", ".join(f"_{n} long" for n in NAMES), make)
    return docs.withColumn("_stats", stats(F.col(text))).select(*[c for c in docs.columns if c != text], "_stats.*")


def base_failed() -> Column:
    return (F.col("_n_words") < 10) | (F.col("_n_repeat_words") * 100 > F.col("_n_words") * 20)


def features(s: pd.DataFrame) -> np.ndarray:
    """Ratios that do not depend on the length of a text: mean and spread of the word length, symbols for each word and for
    each character, share of words with symbols, punctuation for each word. Repetition is left to the base rules."""
    x = {n: s[f"_{n}"].to_numpy(float) for n in NAMES}
    n, chars = np.maximum(1, x["n_words"]), np.maximum(1, x["word_chars"])
    mean = x["word_chars"] / n
    spread = np.sqrt(np.maximum(0, x["sq_chars"] / n - mean**2))
    return np.stack([mean, spread, x["n_symbols"] / n, x["n_symbols"] / chars, x["n_symbol_words"] / n, x["n_punct"] / n], 1)


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary search tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class IsolationForest:
    """Trees as flat arrays: feature (-1: leaf), threshold, left child (right is the next), and the leaf's path length."""

    def __init__(self, points: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size = max(2, min(subsample, len(points)))
        self.trees = [self._grow(points[rng.choice(len(points), min(subsample, len(points)), replace=False)], rng) for _ in range(trees)] if len(points) else []

    def _grow(self, points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        feature, cut, left, path = [0], [0.0], [0], [0.0]
        limit, todo = int(np.ceil(np.log2(self.size))), [(0, points, 0)]
        while todo:
            node, x, depth = todo.pop()
            low, high = x.min(0), x.max(0)
            open_dims = np.flatnonzero(high > low)
            if depth >= limit or len(x) <= 1 or not len(open_dims):
                feature[node], path[node] = -1, depth + expected_path(len(x))
                continue
            f = int(rng.choice(open_dims))
            at = float(rng.uniform(low[f], high[f]))
            feature[node], cut[node], left[node] = f, at, len(feature)
            below = x[:, f] <= at
            for part in (x[below], x[~below]):
                todo.append((len(feature), part, depth + 1))
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                path.append(0.0)
        return np.array(feature), np.array(cut), np.array(left), np.array(path)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near 1: isolated on short paths; about 0.5 and below: usual. 0 for a forest without points."""
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, path in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                i = np.flatnonzero(inner)
                a = at[i]
                at[i] = left[a] + (x[i, feature[a]] > cut[a])
            total += path[at]
        return 2 ** (-total / len(self.trees) / max(1e-9, expected_path(self.size)))


def _sample(table: DataFrame, rows: int) -> np.ndarray:
    """About ``rows`` rows (all, if there are no more), chosen by hash so that the same table always gives the same ones; copies share a fate.

    The 64-bit hash is held against a bar that leaves so many of any number of rows; where copies leave none, the least
    hashes are taken.
    """
    n, names = table.count(), [f"_{x}" for x in NAMES]
    hashed = table.select(*names, F.xxhash64("_id", *names).alias("_h"))
    chosen = hashed.where(F.col("_h") <= F.lit(hash_bar(rows, n))).orderBy("_h", *names).limit(2 * rows).drop("_h").toPandas()
    if n and chosen.empty:
        chosen = hashed.orderBy("_h", *names).limit(rows).drop("_h").toPandas()
    return features(chosen)


def hash_bar(rows: int, n: int) -> int:
    """The greatest of 64-bit signed hashes of which ``rows`` of ``n`` are no greater."""
    return 2**63 - 1 if n <= rows else 2**64 * rows // n - 2**63


@dataclass
class Judge:
    """A forest and the score (in ``BINS`` steps) from which on a row is rejected; beyond all scores without labels."""

    forest: IsolationForest
    threshold: int

    def scores(self, stats: pd.DataFrame) -> np.ndarray:
        return self.forest.scores(features(stats))

    def kept(self, stats: pd.DataFrame) -> np.ndarray:
        words, repeated = stats["_n_words"].to_numpy(), stats["_n_repeat_words"].to_numpy()
        failed = (words < 10) | (repeated * 100 > words * 20)
        return ~failed & (np.floor(self.scores(stats) * BINS) < self.threshold)


def fit(table: DataFrame, labels: DataFrame, seed: int = 0) -> Judge:
    """From rows with ``_id`` and statistics: the forest on a sample of those that pass the base rules, the threshold on all
    labelled ones, each as often as it occurs; an id that is labelled both ways counts as good."""
    names = [f"_{n}" for n in NAMES]
    passed = table.where(~base_failed())
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("quality").alias("_good"))
    judge = Judge(IsolationForest(_sample(passed, SAMPLE_ROWS), seed=seed), BINS + 1)
    shared = table.sparkSession.sparkContext.broadcast(judge)

    @F.pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(pd.DataFrame(dict(zip(names, cols, strict=True)))))

    labelled = passed.select("_id", *names).join(known, F.col("_id") == F.col("_label_id")).select("_good", score(*names).alias("_score"))
    counts = labelled.groupBy("_good", F.floor(F.col("_score") * BINS).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()
    judge.threshold = threshold({r.b: r.n for r in counts if r["_good"] == 1}, {r.b: r.n for r in counts if r["_good"] == 0})
    return judge


def threshold(good: dict[int, int], bad: dict[int, int]) -> int:
    """The step from which on rows are rejected, from the labelled rows of each step.

    Of the steps that lose at most ``GOOD_LOSS`` of the good rows, the one with the greatest difference between the shares of
    bad and of good rows that it rejects, the highest of several; without bad rows the lowest; without good rows none.
    """
    all_good, all_bad = sum(good.values()), sum(bad.values())
    lost, caught, best = 0, 0, (0.0, BINS + 1)
    for b in range(BINS, -1, -1) if all_good else []:
        lost, caught = lost + good.get(b, 0), caught + bad.get(b, 0)
        if lost > GOOD_LOSS * all_good:
            break
        gain = caught / all_bad - lost / all_good if all_bad else 1.0 + BINS - b
        if gain > best[0]:
            best = (gain, b)
    return best[1]


def judge(docs: DataFrame, text: str, labels: DataFrame, seed: int = 0) -> DataFrame:
    """Replaces ``text`` of rows with ``_id`` by their statistics (``_n_words`` ...), ``_score``, ``_base_failed`` and ``_kept``.

    A row is kept if the base rules pass and its score is under the threshold: of those that reject at most ``GOOD_LOSS`` of
    the labelled good rows the one that tells bad from good best. Without labelled good rows the forest rejects nothing. Null and empty texts
    have no words and fail; repeated rows and ties are judged alike; null ids have no label; an empty table stays empty. A
    caller's column with an output column's name goes on under its name and ``_given``.
    """
    names = [f"_{n}" for n in NAMES]
    table = written(statistics(set_aside(docs, ", ".join([*names, "_score", "_base_failed", "_kept", "_stats"])), text), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, labels, seed))

    @F.pandas_udf("_score double, _kept boolean")
    def judged(*cols: pd.Series) -> pd.DataFrame:
        stats = pd.DataFrame(dict(zip(names, cols, strict=True)))
        return pd.DataFrame({"_score": shared.value.scores(stats), "_kept": shared.value.kept(stats)})

    return table.withColumn("_stats", judged(*names)).withColumn("_base_failed", base_failed()).select(*table.columns, "_base_failed", "_stats.*")


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's digest."""
    out = judge(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), "_text", labels)
    names = [x.split()[0] for x in STATS.split(", ")]
    return out.select(
        F.col("_id").alias("doc_id"), *(F.col(f"_{n}").alias(n) for n in names), F.col("_base_failed").alias("base_failed"),
        F.col("_kept").alias("kept"), F.col("_score").alias("score"),
    )


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole documents that are kept, with the columns they came with (any names), repeated ones included.

    Nulls, empty texts, ties and empty tables are treated as ``judge`` treats them.

    The statistics are made twice, once to fit the forest and once to filter where the documents lie: that costs less than
    to shuffle or copy all texts.
    """
    table = written(statistics(docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")), "_text"), "statistics")
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, labels))

    def make(texts: list[bytes | None]) -> dict[str, list]:
        stats = pd.DataFrame([text_stats(t) for t in texts], columns=[f"_{n}" for n in NAMES], dtype="int64")
        return {"kept": shared.value.kept(stats).tolist()}

    return docs.where(text_udf("kept boolean", make)(F.col("text"))["kept"])
