"""Column builders over text: stable hashes, sentiment, page and mail-record detectors, keyword snippets, hashed vectors."""

from __future__ import annotations

import functools
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

WORD = 1 << 32

# Words of the review lexicon.
POSITIVE = "accogliente adoro amore bellissimo bello bravo buon buonissimo buono consigliato contento cordiale cortese delizioso disponibile eccellente fantastico felice gentile gradevole impeccabile magnifico ottima ottimo perfetto piacevole positive professionale pulito qualità rapido simpatico soddisfatto speciale super top unico valido veloce".split()
NEGATIVE = "affollato arrabbiato bruttissimo brutto caro cattiva cattivo deludente delusa deluso difetto difettoso disastro disgustoso errore fuori inferiore insufficiente lamentela lamentele lento maleducato negativo noioso orrendo orribile orrore peggio peggiore pessima pessimo problemi rumoroso scadente scarso schifo scortese scortesia sporco squallido terribile triste".split()
NEGATIONS = "mai neanche nemmeno neppure nessuna nessuno non nulla".split()
INTENSIFIERS = "assolutamente davvero estremamente incredibilmente molto super troppo veramente".split()

# Marks that name the builder of a site, in order of precedence.
SITE_BUILDERS = {
    "WordPress": ["/wp-content/", "/wp-includes/", 'name="generator" content="wordpress', "wp-emoji-release.min.js"],
    "Wix": ["wix.com", "x-wix-request-id", "wixsite", "wixdata", "wix-ui", 'id="comp-', "id='comp-", " comp-"],
    "Shopify": ["shopify"],
    "Squarespace": ["squarespace"],
}
NO_BUILDER = "Custom HTML"


def _rolling_hashes(texts: pd.Series, start: int, factor: int) -> np.ndarray:
    """Unsigned 32-bit ``h = h * factor + unit`` over the UTF-16 code units of each text, by powers of the factor."""
    powers = np.ones(1, np.uint32)
    out = np.zeros(len(texts), np.uint32)
    for n, text in enumerate(texts):
        units = np.frombuffer(("" if text is None else text).encode("utf-16-le"), np.uint16).astype(np.uint32)
        while len(powers) <= len(units):
            powers = np.concatenate([powers, powers * np.uint32(pow(factor, len(powers), WORD))])
        out[n] = np.uint32((int((units * powers[: len(units)][::-1]).sum(dtype=np.uint64)) + start * int(powers[len(units)])) % WORD)
    return out


def stable_hash(text: Column) -> Column:
    """djb2 in base 36, seven digits at least; null stays null."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(_rolling_hashes(texts, 5381, 33).astype(np.int64))

    return F.when(text.isNotNull(), F.lpad(F.lower(F.conv(hashed(text).cast("string"), 10, 36)), 7, "0"))


def page_hash(text: Column) -> Column:
    """31-polynomial of 32 bits with sign, printed as ``h`` and the hex digits of its absolute value; null stays null."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series(np.abs(_rolling_hashes(texts, 0, 31).view(np.int32).astype(np.int64)))

    return F.when(text.isNotNull(), F.concat(F.lit("h"), F.lower(F.hex(hashed(text)))))


def sentiment(text: Column, stars: Column) -> Column:
    """Score from -1 to 1: lexicon words, turned by a negation and raised by an intensifier before them; stars weigh 0.4.

    Null texts have no words. Stars that are null or outside 1 to 5 don't count.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zàèéìòù']+)"), F.lit(1))

    def value(w: Column, before: Column) -> Column:
        sign = F.when(w.isin(POSITIVE), 1.0).when(w.isin(NEGATIVE), -1.0).otherwise(0.0)
        return sign * F.when(before.isin(NEGATIONS), -1.0).otherwise(1.0) * F.when(before.isin(INTENSIFIERS), 1.5).otherwise(1.0)

    shifted = F.concat(F.array(F.lit("")), words)  # a look-back inside the lambda would split the text again for each word
    total = F.aggregate(F.zip_with(words, shifted, value), F.lit(0.0), lambda s, v: s + v)
    said = total / F.greatest(F.lit(3.0), F.abs(total))
    return F.round(F.when(stars.between(1, 5), said * 0.6 + (stars - 3) / 2 * 0.4).otherwise(said), 3)


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.25, "positive").when(score < -0.25, "negative").otherwise("neutral")


def site_builder(html: Column) -> Column:
    """The first builder with a mark in the page; null pages have none."""
    h = F.lower(F.coalesce(html, F.lit("")))
    out = F
    for name, marks in SITE_BUILDERS.items():
        out = out.when(functools.reduce(Column.__or__, [F.contains(h, F.lit(m)) for m in marks]), name)
    return out.otherwise(NO_BUILDER)


def mail_policy(records: Column, kind: str) -> Column:
    """``missing``, ``warning`` (a policy that lets all pass) or ``ok`` for the first ``spf`` or ``dmarc`` record of a list."""
    first = F.get(F.filter(records, lambda r: F.lower(r).startswith(f"v={kind}1")), 0)
    weak = F.contains(first, F.lit("+all")) if kind == "spf" else F.contains(F.lower(first), F.lit("p=none"))
    return F.when(first.isNull(), "missing").when(weak, "warning").otherwise("ok")


def keyword_snippets(text: Column, keywords: list[str], before: int = 40, after: int = 60, most: int = 5) -> Column:
    """Structs (keyword, snippet) of the first ``most`` keywords that the text has, each with its surroundings."""

    def hit(k: str) -> Column:
        at = F.instr(F.lower(text), k.lower())
        start = F.greatest(F.lit(1), at - before)
        cut = F.translate(F.substring(text, start, at - start + len(k) + after), "\n", " ")
        return F.when(at > 0, F.struct(F.lit(k).alias("keyword"), F.regexp_replace(cut, r"^\s+|\s+$", "").alias("snippet")))

    return F.slice(F.filter(F.array(*[hit(k) for k in keywords]), lambda x: x.isNotNull()), 1, most)


TOKEN = re.compile("[a-z0-9]{2,}")
MARK = re.compile("[\u0300-\u036f]")
#: Texts that are hashed at once; bounds the vectors in memory.
HASHED = 512


def fnv_words(tokens: list[str]) -> np.ndarray:
    """32-bit FNV-1a hashes of ASCII tokens, all tokens of a length at once."""
    out = np.zeros(len(tokens), np.uint64)
    by_length: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        by_length.setdefault(len(t), []).append(i)
    for n, at in by_length.items():
        letters = np.frombuffer("".join(tokens[i] for i in at).encode(), np.uint8).reshape(len(at), n)
        h = np.full(len(at), 2166136261, np.uint64)
        for k in range(n):
            h = (h ^ letters[:, k]) * np.uint64(16777619) % np.uint64(WORD)
        out[at] = h
    return out


def hashed_vectors(texts: list[str | None], dim: int) -> np.ndarray:
    """Unit vectors of texts: each distinct token is hashed once, and all occurrences are added in one go."""
    known: dict[str, int] = {}
    rows, codes = [], []
    for i, text in enumerate(texts):
        low = (text or "").lower()
        tokens = TOKEN.findall(low if low.isascii() else MARK.sub("", unicodedata.normalize("NFD", low)))
        rows.append(np.full(len(tokens), i))
        codes.append(np.fromiter((known.setdefault(t, len(known)) for t in tokens), np.int64, len(tokens)))
    row, code = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64), np.concatenate([np.zeros(0, np.int64), *codes])
    h = fnv_words(list(known)).astype(np.int64)
    weight = (1 - 2 * (h & 1)) * (1 + np.array([len(t) % 5 for t in known], float) * 0.1)
    out = np.zeros((len(texts), dim))
    np.add.at(out, (row, h[code] % dim), weight[code])
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-300)


def hashed_vector(dim: int = 384):
    """A column function: unit vector of a text's folded tokens of two letters or more; zeros for null or no token."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def hashed(texts: pd.Series) -> pd.Series:
        parts = [hashed_vectors(texts.iloc[k : k + HASHED].tolist(), dim) for k in range(0, len(texts), HASHED)]
        return pd.Series([v for p in parts for v in p], dtype=object)

    return hashed
