"""Column builders: identities, dates, numbers, vectors, text. All stay inside Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + 0.5)


def clamp(x: Column, low: float = 0, high: float = 100) -> Column:
    """Rounded and kept between the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), half_up(x))))


def normalize_domain(raw: Column) -> Column:
    """Host in lower case without ``www.`` and port; null for blank input or white space inside."""
    s = F.lower(F.trim(raw))
    host = F.regexp_extract(F.regexp_replace(s, r"^https?://", ""), r"^(?:[^/?#@]*@)?([^/?#:@\s]+)(?::\d*)?(?:[/?#].*)?$", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normalize_phone(raw: Column) -> Column:
    """Digits; under six are null; ten digits that begin with 3 get the country code 39."""
    d = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(F.length(d) < 6, None).when(d.startswith("3") & ~d.startswith("39") & (F.length(d) == 10), F.concat(F.lit("39"), d)).otherwise(d)


def normalize_email(raw: Column) -> Column:
    e = F.lower(F.trim(raw))
    return F.when(e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), e)


def normalize_vat(raw: Column) -> Column:
    d = F.regexp_replace(raw, r"[^0-9]", "")
    return F.when(F.length(d) == 11, F.concat(F.lit("IT"), d))


def slug_name(raw: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", "-"), r"[^a-z0-9\-]", "")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-|-$", "")


def slug_technology(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), r"\s+", "_"), "[^a-z0-9_]", "")


def slug_location(city: Column, country: Column) -> Column:
    return F.when(slug_technology(city) != "", F.concat_ws(":", F.lower(country), slug_technology(city)))


def canonical_company(domain: Column, vat: Column, phone: Column) -> Column:
    return F.coalesce(normalize_domain(domain), normalize_vat(vat), normalize_phone(phone))


def first_key(*keys: tuple[str, Column]) -> Column:
    """The first usable identity with its prefix, for deduplication."""
    return F.coalesce(*(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{p}:"), v)) for p, v in keys))


def day_key(*parts: Column, at: Column) -> Column:
    """Idempotency key with day grain (UTC)."""
    return F.concat_ws(":", *parts, F.date_format(at, "yyyy-MM-dd"))


def days_between(end: Column, start: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000


def freshness(age_days: Column) -> Column:
    """100 today, 0 at thirty days and beyond; null ages are 0."""
    return F.coalesce(clamp(F.lit(100.0) - age_days / 30 * 100), F.lit(0)).cast("long")


def parse_number(raw: Column) -> Column:
    """``1.234,5`` and the like; null where it is no number."""
    plain = F.replace(F.replace(F.regexp_replace(raw, "[^0-9,.-]", ""), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("double")


def to_bool(raw: Column) -> Column:
    """``true``, ``yes``, ``si``, ``1`` and ``false``, ``no``, ``0`` in any case; else null."""
    s = F.lower(F.trim(raw.cast("string")))
    return F.when(s.isin("true", "yes", "si", "1"), True).when(s.isin("false", "no", "0"), False)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def strip_html(html: Column) -> Column:
    s = F.regexp_replace(html, r"(?is)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "<[^>]+>", " "), r"\s+", " "))


def token_similarity(a: Column, b: Column, most: int = 400) -> Column:
    """Share of a's tokens (repeats count) that b has, over the longer of both lists; 1 for two empty texts.

    Both lists are made once for a row; a's tokens are looked up in the shorter of the lists of shared and of missing tokens.
    """

    def share(x: Column) -> Column:
        ta, tb = x["a"], x["b"]
        longer = F.greatest(F.size(ta), F.size(tb))
        return F.when(longer == 0, 1.0).otherwise(hits(F.struct(ta.alias("a"), F.array_intersect(ta, tb).alias("shared"), F.array_except(ta, tb).alias("missing"))) / longer)

    def hits(x: Column) -> Column:
        def looked_up(y: Column) -> Column:
            few = F.size(y["missing"]) < F.size(y["shared"])
            return F.when(few, F.size(y["a"]) - F.size(F.filter(y["a"], lambda t: F.array_contains(y["missing"], t)))).otherwise(F.size(F.filter(y["a"], lambda t: F.array_contains(y["shared"], t))))

        return _bound(x, looked_up)

    ta, tb = (F.slice(F.filter(F.split(x, r"\s+"), lambda t: t != ""), 1, most) for x in (a, b))
    return _bound(F.struct(ta.alias("a"), tb.alias("b")), share)


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value made once; a lambda that names an expression would make it anew for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def contains_ci(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").otherwise("F")


def intent_label(score: Column) -> Column:
    return F.when(score >= 80, "hot").when(score >= 60, "warm").when(score >= 30, "tepid").otherwise("cold")


def headline(summary: Column, job_title: Column, website: Column) -> Column:
    """A summary's first 160 characters, else the job, else the site; else empty."""
    return F.coalesce(F.substring(summary, 1, 160), job_title, F.concat(F.lit("Sito: "), website), F.lit(""))
