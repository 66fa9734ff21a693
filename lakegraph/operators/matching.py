"""Which records speak of the same company: exact identities first, then names of one city that share tokens, hold each other or are nearly the same."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lakegraph.operators.similarity import near_names
from lakegraph.sources.sinks import stored as written

# Name tokens that identify nobody.
GENERIC_TOKENS = "srl spa sas snc group holding italia italy service services impresa imprese azienda company societa studio centro".split()

#: Accented letters of Latin-1 and Latin Extended-A, and the letters that they decompose to.
_PAIRS = [(c, unicodedata.normalize("NFKD", c)[0]) for c in map(chr, range(0xE0, 0x180)) if c.islower() and unicodedata.normalize("NFKD", c)[0].isascii()]
ACCENTS = ("".join(c for c, _ in _PAIRS), "".join(plain for _, plain in _PAIRS))


def folded(text: Column) -> Column:
    """Lower case without accents; punctuation becomes a space; null is empty."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def name_tokens(text: Column) -> Column:
    """Distinct tokens of two characters or more that are not generic."""
    return F.array_distinct(F.filter(F.split(folded(text), " "), lambda t: (F.length(t) >= 2) & ~t.isin(GENERIC_TOKENS)))


def local_phone(phone: Column) -> Column:
    """The last ten digits without country code; shorter than nine stay as they are; empty is null."""
    d = F.regexp_replace(phone, "[^0-9]", "")
    d = F.when(d.startswith("39") & (F.length(d) > 10), F.substr(d, F.lit(3))).otherwise(d)
    return F.nullif(F.when(F.length(d) >= 9, F.right(d, F.lit(10))).otherwise(d), F.lit(""))


def token_score(a: Column, b: Column) -> Column:
    """Shared tokens over the longer list, in percent; 0 below two shared ones where both lists have two."""
    shared = F.size(F.array_intersect(a, b))
    need = F.least(F.lit(2), F.size(a), F.size(b))
    return F.when((shared == 0) | (shared < need), 0.0).otherwise(shared / F.greatest(F.size(a), F.size(b)) * 100)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, in percent."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() * 100 for x, y in zip(a, b)])


def easy_ratio(a: Column, b: Column) -> Column:
    """0 for an empty name, 100 for equal folded names, 92 where one contains the other; else null."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 100.0).when(F.contains(a, b) | F.contains(b, a), 92.0)


def _prepared(df: DataFrame, side: str) -> DataFrame:
    """Expects ``id, name, city, vat, domain, phone``; blank identities are null."""
    vat = F.regexp_replace("vat", "[^0-9]", "")
    cols = {"id": F.col("id"), "name": folded(F.col("name")), "tokens": name_tokens(F.col("name")), "city": folded(F.col("city")), "vat": F.when(F.length(vat) == 11, vat), "domain": F.nullif(F.col("domain"), F.lit("")), "phone": local_phone(F.col("phone"))}
    return df.select(*[c.alias(f"{side}_{n}") for n, c in cols.items()])


def _ranked_tokens(df: DataFrame, side: str, frequency: DataFrame) -> DataFrame:
    """``id, city, token, place, n, prefix``: tokens from the rarest on.

    Names of two tokens and more that share half of the longer list share two tokens at least and half of their own, so that
    they have a token in common among the first ``prefix`` of each. A name of one token is another matter.
    """
    rows = df.select(f"{side}_id", F.col(f"{side}_city").alias(f"{side}_city"), F.size(f"{side}_tokens").alias("n"), F.explode(f"{side}_tokens").alias("token")).join(frequency, "token")
    w = Window.partitionBy(f"{side}_id").orderBy("many", "token")
    need = F.greatest(F.ceil(F.col("n") / 2), F.least(F.lit(2), F.col("n")))
    return rows.select(f"{side}_id", f"{side}_city", "token", "n", F.row_number().over(w).alias("place"), (F.col("n") - need + 1).alias("prefix"))


def city_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``lead_city, record_city``: distinct cities of which one contains the other; an empty lead city goes with every record city."""
    left, right = a.select("lead_city").distinct(), b.select("record_city").distinct()
    inside = containing(left, "lead_city", right, "record_city").unionByName(containing(right, "record_city", left, "lead_city").select("lead_city", "record_city"))
    # One row at most on the left: the empty city.
    return inside.unionByName(left.where("lead_city = ''").join(right, F.lit(True))).distinct()


def named_alike(a: DataFrame, b: DataFrame, cities: DataFrame) -> list[DataFrame]:
    """``lead_id, record_id`` where one name holds the other, either way, and where the letters are nearly the same.

    Only names that such a likeness can get accepted are looked at: leads of two tokens, or of one with six letters, and
    records that don't consist of generic tokens. Equal names of
    a city stand for all their rows until the pairs are found.
    """
    could = (F.size("lead_tokens") >= 2) | (F.length(F.get("lead_tokens", F.lit(0))) >= 6)
    rows = a.where(could & (F.col("lead_name") != "")).join(cities, "lead_city").select("lead_id", "lead_name", "record_city")
    named = b.where(F.size("record_tokens") > 0).select("record_id", "record_name", "record_city")
    leads, records = rows.select("lead_name", "record_city").distinct(), named.select("record_name", "record_city").distinct()
    near = near_names(leads.select(F.col("lead_name").alias("id"), F.col("record_city").alias("place"), F.col("lead_name").alias("name")), records.select(F.col("record_name").alias("id"), F.col("record_city").alias("place"), F.col("record_name").alias("name")), by_place=True)
    near = near.select(F.col("left_id").alias("lead_name"), F.col("right_id").alias("record_name"), F.col("place").alias("record_city"))
    holds = containing(leads, "lead_name", records, "record_name", ["record_city"]).unionByName(containing(records, "record_name", leads, "lead_name", ["record_city"]))
    alike = near.unionByName(holds).distinct()
    return [alike.join(rows, ["lead_name", "record_city"]).join(named, ["record_name", "record_city"]).select("lead_id", "record_id")]


def match_companies(leads: DataFrame, records: DataFrame, letters: bool = True) -> DataFrame:
    """``lead_id, record_id, score, reason, accepted, ambiguous`` of the pairs that are accepted, and of each lead's best pair.

    Candidates share a VAT number, domain or phone, or are of one city (one contains the other, or the lead has none) and
    have half of their name tokens in common, one folded name inside the other, or names with a letter ratio of 88 or more.
    VAT decides alone where both have one; then domain 95, phone 90, then names: 75 with half of the tokens shared, 88
    with two tokens, 92 with one of six letters. Every pair that these rules accept is found, also with a typing error in
    every word. ``ambiguous``: of several candidates the lead's best scores under 75 or the second at least 0.85 of it.
    Ids must be unique on each side; null names have no tokens. Names are compared letter by letter only where nothing
    else decides. Without ``letters``, pairs that share neither an identity nor half of their tokens are not looked for:
    all pairs accepted for ``vat``, ``domain``, ``phone`` or ``name and city`` are there, ``similar name``, ``single token``
    and the best of the others may lack some.
    """
    a, b = written(_prepared(leads, "lead"), "leads"), written(_prepared(records, "record"), "records")
    frequency = a.select(F.explode("lead_tokens").alias("token")).unionAll(b.select(F.explode("record_tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("many"))
    left, right = _ranked_tokens(a, "lead", frequency), _ranked_tokens(b, "record", frequency)
    pairs = [a.join(b, a[f"lead_{k}"] == b[f"record_{k}"]).select("lead_id", "record_id") for k in ("vat", "domain", "phone")]
    cities = written(city_pairs(a, b), "cities")
    left = left.join(cities, "lead_city").select("lead_id", "record_city", "token", "n", "place", "prefix")
    # a name of one token shares half of a name of two by either of its tokens, every other half by a rare one
    for l, r in (("place <= prefix", "place <= prefix"), ("n = 1", "n = 2"), ("n = 2", "n = 1")):
        pairs.append(left.where(l).join(right.where(r), ["token", "record_city"]).select("lead_id", "record_id"))
    pairs += named_alike(a, b, cities) if letters else []
    all_pairs = reduce(DataFrame.unionByName, pairs)
    both = all_pairs.distinct().join(a, "lead_id").join(b, "record_id")
    same = {k: F.coalesce(F.col(f"lead_{k}") == F.col(f"record_{k}"), F.lit(False)) for k in ("vat", "domain", "phone")}
    two_vats = F.col("lead_vat").isNotNull() & F.col("record_vat").isNotNull()
    n, first = F.size("lead_tokens"), F.length(F.get("lead_tokens", F.lit(0)))
    place = (F.col("lead_city") == "") | ((F.col("record_city") != "") & (F.contains("lead_city", "record_city") | F.contains("record_city", "lead_city")))
    exact = F.when(two_vats & same["vat"], "vat").when(two_vats, "other vat").when(same["domain"], "domain").when(same["phone"], "phone").when(n == 0, "no name")
    both = both.withColumns({"exact": exact, "place": place, "tokens": token_score(F.col("lead_tokens"), F.col("record_tokens")), "easy": easy_ratio(F.col("lead_name"), F.col("record_name"))})
    both = written(both, "candidates")
    open_ = F.col("exact").isNull() & F.col("easy").isNull()
    decided = both.where(~open_).withColumn("ratio", F.col("easy"))
    compared = both.where(open_).withColumn("ratio", sequence_ratio(F.col("lead_name"), F.col("record_name")))
    both = decided.unionByName(compared).withColumn("name", F.greatest("tokens", F.coalesce("ratio", F.lit(0.0))))
    reason = (
        F.when(F.col("exact").isNotNull(), F.col("exact")).when(~F.col("place"), "other city")
        .when((F.col("name") >= 75) & (F.col("tokens") >= 50), "name and city")
        .when((F.col("name") >= 88) & (n >= 2), "similar name").when((F.col("name") >= 92) & (n == 1) & (first >= 6), "single token").otherwise("weak name")
    )
    both = both.withColumn("reason", reason)
    fixed = F.when(F.col("reason") == "vat", 100.0).when(F.col("reason").isin("other vat", "no name"), 0.0).when(F.col("reason") == "domain", 95.0).when(F.col("reason") == "phone", 90.0)
    both = both.withColumn("score", F.coalesce(fixed, F.when(F.col("reason") == "other city", F.col("name") * 0.5).otherwise(F.col("name"))))
    best = Window.partitionBy("lead_id").orderBy(F.desc("score"), "record_id")
    both = both.withColumn("_r", F.row_number().over(best)).withColumn("_next", F.lead("score").over(best))
    of_lead = Window.partitionBy("lead_id")
    top, second = F.max(F.when(F.col("_r") == 1, F.col("score"))).over(of_lead), F.max(F.when(F.col("_r") == 1, F.col("_next"))).over(of_lead)
    ambiguous = F.coalesce((top < 75) | (second >= top * 0.85), F.lit(False)) & second.isNotNull()
    accepted = ~F.col("reason").isin("other vat", "no name", "other city", "weak name")
    out = both.select("lead_id", "record_id", "score", "reason", accepted.alias("accepted"), ambiguous.alias("ambiguous"), "_r")
    return out.where("accepted or _r = 1").drop("_r")


def by_site_or_name(leads: DataFrame, deals: DataFrame) -> DataFrame:
    """``id, deal``: the deal with the lead's site, else the one with its name; the least deal id wins. Null keys match nothing."""
    sites = deals.groupBy(F.col("site").alias("_s")).agg(F.min("deal").alias("_by_site"))
    names = deals.groupBy(F.lower(F.trim("name")).alias("_n")).agg(F.min("deal").alias("_by_name"))
    out = leads.join(sites, F.col("site") == F.col("_s"), "left").join(names, F.lower(F.trim("name")) == F.col("_n"), "left")
    return out.select("id", F.coalesce("_by_site", "_by_name").alias("deal"))


def suffix_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_id, right_id`` where one host is the other or ends with it after a dot.

    Each host is exploded to its suffixes of two labels or more, so both directions are equi joins. Both sides have ``id, host``.
    """

    def suffixes(df: DataFrame) -> DataFrame:
        labels = F.split("host", r"\.")
        starts = F.when(F.size(labels) >= 2, F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array().cast("array<int>"))
        return df.where("host is not null").select("id", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))

    l, r = left.select(F.col("id").alias("left_id"), "host"), right.select(F.col("id").alias("right_id"), "host")
    down = suffixes(left).withColumnRenamed("id", "left_id").join(r, F.col("suffix") == F.col("host")).select("left_id", "right_id")
    up = suffixes(right).withColumnRenamed("id", "right_id").join(l, F.col("suffix") == F.col("host")).select("left_id", "right_id")
    return down.unionByName(up).distinct()


def fill_blanks(leads: DataFrame, known: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Leads whose blank ``fields`` come from ``known`` by the first of ``keys`` that hits; own values stay. ``known`` has one row a key."""
    out = leads
    for k in keys:
        side = known.where(F.col(k).isNotNull()).select(F.col(k).alias("_k"), *[F.col(f).alias(f"_{k}_{f}") for f in fields])
        out = out.join(side, F.col(k) == F.col("_k"), "left").drop("_k")
    filled = [F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), *[F.col(f"_{k}_{f}") for k in keys]).alias(f) for f in fields]
    return out.select(*[c for c in leads.columns if c not in fields], *filled)


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str, same: list[str] | None = None) -> DataFrame:
    """Pairs of rows where ``text`` contains ``needle``, as an equi join; columns ``same`` of both must be equal.

    Every part of a text that is as long as some needle is a key; the lengths that occur are few (domains: at most 253) and
    the only thing that comes to the driver. Null and empty needles match nothing.
    """
    keys = needles.where(F.length(needle) > 0)
    lengths = sorted(r[0] for r in keys.select(F.length(needle)).distinct().collect())
    n = F.length(text)
    if not lengths:
        return texts.join(keys, same).where(F.lit(False)) if same else texts.join(keys, F.lit(False))

    def cut(size: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    # Spark takes the parts to be as small as the texts and would send all of them to every task
    pieces = texts.withColumn("_part", F.explode(F.array_distinct(F.concat(*[cut(k) for k in lengths])))).hint("merge")
    if same:
        return pieces.join(keys.withColumn("_part", F.col(needle)), ["_part", *same]).drop("_part")
    return pieces.join(keys, F.col("_part") == F.col(needle)).drop("_part")
