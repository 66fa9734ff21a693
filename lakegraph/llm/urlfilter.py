"""URL filters: host and path rules, and a Bloom filter cascade over the corpus's complete key universe.

A url's keys are its host, the host's parent domains, and host and path together. Level 0 of the cascade holds the listed
keys. Level 1 holds the unlisted keys of the universe that pass level 0, level 2
the listed keys that pass level 1, and so on until no key of the universe is judged wrongly. Asking the levels in turn
then gives exact membership for every key of the universe, without a join. Keys are dealt by hash into as many cascades as
keep each within a bound of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakegraph.llm.common import set_aside, written

#: (rule, verdict): host, then path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Hosts that are blocked with their subdomains where no rule fits.
LISTED = ("casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com")
BITS_PER_KEY = 10
PROBES = 5
#: Share of other keys that pass a level, about.
PASSING = 0.0094
#: Bytes of one cascade's levels, about; larger lists are dealt into several cascades that are asked one after the other.
MAX_FILTER_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    parts = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def keys_of(host: Column, path: Column) -> Column:
    """What a list may hold of a url: its host, the parent domains, and host and path where there is a path."""
    page = F.when((host != "") & (path != ""), F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>"))
    return F.concat(suffixes(host), page)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits. Of equally long rules the one with the longer host wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0].index("/"))):
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def level_hash(key: Column, level: int) -> Column:
    return F.xxhash64(F.lit(level), key)


def probe_bits(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether all bits of each hash are set."""
    h = hashes.view(np.uint64)
    a, b, m = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1), np.uint64(len(words) * 64)
    ok = np.ones(len(h), bool)
    for i in range(PROBES):
        at = (a + np.uint64(i) * b) % m
        ok &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


@dataclass
class Cascade:
    """Bit words of each level. Exact for every key of the universe that it was built over."""

    levels: list[np.ndarray]

    @property
    def bytes(self) -> int:
        return sum(w.nbytes for w in self.levels)

    def listed(self, hashes: list[np.ndarray]) -> np.ndarray:
        """hashes: of the keys, for each level."""
        verdict = np.full(len(hashes[0]), len(self.levels) % 2 == 1)
        still = np.ones(len(verdict), bool)
        for i, words in enumerate(self.levels):
            out = still & ~probe_bits(hashes[i], words)
            verdict[out] = i % 2 == 1
            still &= ~out
        return verdict


def _level(keys: DataFrame, n: int, level: int) -> np.ndarray:
    """Bits are set by an aggregation in Spark; only the words of the filter come to the driver."""
    size = max(1, -(-n * BITS_PER_KEY // 64))
    h = level_hash(F.col("key"), level)
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    at = F.explode(F.array(*((low + high * i) % (size * 64) for i in range(PROBES))))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    bits = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(size, np.int64)
    words[bits["word"].to_numpy()] = bits["bits"].to_numpy()
    return words.view(np.uint64)


def build_cascade(listed: DataFrame, rest: DataFrame) -> Cascade:
    """From two ``key`` columns without nulls, repetitions and common keys: the listed keys and the rest of the universe."""
    inside, outside, levels = listed, rest, []
    while True:
        n = inside.count()
        if not n and levels:
            return Cascade(levels)
        levels.append(_level(inside, n, len(levels)))
        inside, outside = written(_passing(outside, levels[-1], len(levels) - 1), "false-positives"), inside


def build_cascades(listed: DataFrame, universe: DataFrame, most_bytes: int = MAX_FILTER_BYTES) -> tuple[int, Iterator[Cascade]]:
    """How many cascades, and each in turn, from ``key`` columns; null keys don't count. Only one is in the driver at a time."""
    listed = written(listed.where("key is not null").select("key").distinct(), "listed")
    rest = written(universe.where("key is not null").select("key").distinct().join(listed, "key", "left_anti"), "unlisted")
    size = (listed.count() + PASSING * rest.count()) * BITS_PER_KEY / 8
    shards = max(1, -(-int(size) // most_bytes))
    return shards, (build_cascade(*(df.where(shard_of(F.col("key"), shards) == k) for df in (listed, rest))) for k in range(shards))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))


def _passing(keys: DataFrame, words: np.ndarray, level: int) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def passes(h: pd.Series) -> pd.Series:
        return pd.Series(probe_bits(h.to_numpy(np.int64), shared.value))

    return keys.where(passes(level_hash(F.col("key"), level)))


def any_listed(df: DataFrame, keys: Column, cascade: Cascade) -> Column:
    """Whether any key of an array column is listed."""
    shared, n = df.sparkSession.sparkContext.broadcast(cascade), len(cascade.levels)

    @F.pandas_udf("boolean")
    def ask(*hashes: pd.Series) -> pd.Series:
        sizes = hashes[0].map(len).to_numpy()
        out = np.zeros(len(sizes), bool)
        if sizes.sum():
            flat = shared.value.listed([np.concatenate(h.to_numpy()).astype(np.int64) for h in hashes])
            np.logical_or.at(out, np.repeat(np.arange(len(sizes)), sizes), flat)
        return pd.Series(out)

    def hashed(level: int) -> Column:
        return F.transform(keys, lambda k: level_hash(k, level))

    return ask(*map(hashed, range(n)))


def _keys_of_shard(keys: Column, k: int, shards: int) -> Column:
    return keys if shards == 1 else F.filter(keys, lambda x: shard_of(x, shards) == k)


OUT = "_host string, _path string, _rule string, _verdict string"


def judge_urls(pages: DataFrame, url: str, listed: DataFrame, rules=RULES, most_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds ``_host``, ``_path``, ``_rule`` and ``_verdict`` (allow or block) to the rows.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed. Repeated rows are judged
    alike; an empty list or table is no error. Listed keys are hosts, which stand for their subdomains, and hosts with a
    path; a list beyond ``most_bytes`` is dealt into several cascades, and the rows are written between them. Of equally
    long rules the one with the longer host wins. A caller's column with an output column's name goes on under its name
    and ``_given``.
    """
    split = set_aside(pages, OUT + ", _says string, _bad boolean")
    split = split.withColumn("_host", host_of(F.col(url))).withColumn("_path", path_of(F.col(url)))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    split = split.withColumn("_rule", rule).withColumn("_says", verdict)
    keys = keys_of(F.col("_host"), F.col("_path"))
    universe = split.select("_host", "_path").distinct().select(F.explode(keys).alias("key"))
    shards, cascades = build_cascades(listed, universe, most_bytes)
    asked = split.withColumn("_bad", F.lit(False))
    for k, cascade in enumerate(cascades):
        asked = written(asked, "asked") if k else asked
        asked = asked.withColumn("_bad", F.col("_bad") | any_listed(asked, _keys_of_shard(keys, k, shards), cascade))
    return asked.withColumn("_verdict", F.coalesce("_says", F.when(F.col("_bad"), "block").otherwise("allow"))).drop("_says", "_bad")


def keys_frame(spark: SparkSession, keys) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, keys)).cast("array<string>")).alias("key"))


def tracked_keys(pages: DataFrame, url: str) -> DataFrame:
    """Host and path of every url that some row has with a tracking parameter (``utm_source=`` in its query)."""
    query = F.regexp_extract(F.col(url), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    tracked = pages.where(query.contains("utm_source="))
    return tracked.select(F.concat(host_of(F.col(url)), path_of(F.col(url))).alias("key")).where(host_of(F.col(url)) != "")


def page_verdicts(pages: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """The query's digest. The list: fixed hosts, and the pages that some url tracks."""
    rows = pages.select("page_id", F.col("url").alias("_url"))
    if listed is None:
        listed = keys_frame(pages.sparkSession, LISTED).unionByName(tracked_keys(rows, "_url"))
    out = judge_urls(rows, "_url", listed)
    return out.select("page_id", *(F.col(f"_{c}").alias(c) for c in ("host", "path", "rule", "verdict")))
