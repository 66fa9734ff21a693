"""Predicates and scores over lead rows, as columns. Missing values follow the rule stated at each function."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakegraph.functions.columns import clamp, contains_ci, half_up

# Contact texts that mean "none", and mail domains of page templates.
NO_CONTACT = ["", "n/d", "n/a", "none", "null", "n.d.", "undefined"]
TEMPLATE_DOMAINS = "website.com example.com email.com sito.com domain.com test.com yoursite.com yourdomain.com tuosito.com tuodominio.com sitoweb.com miosito.com nomedominio.com nomesito.com sample.com placeholder.com mail.com".split()

# Rank of the pipeline stages; the last two are terminal.
STAGES = {"nuovo": 0, "contattato": 1, "meeting": 2, "proposta": 3, "vinto": 4, "perso": 4}


@dataclass(frozen=True)
class LeadFilter:
    """What a lead must be like; None asks for nothing."""

    tag_manager: bool | None = None
    meta_pixel: bool | None = None
    ssl: bool | None = None
    seo_errors: bool | None = None
    mobile: bool | None = None
    speed: str | None = None
    instagram: bool | None = None
    bad_reviews: bool | None = None
    revenue_min: float | None = None
    revenue_max: float | None = None
    employees_min: int | None = None
    employees_max: int | None = None
    founded_after: str | None = None
    founded_before: str | None = None


def _all(tests: list[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def is_true(c: Column) -> Column:
    return c.eqNullSafe(True)


def present(c: Column) -> Column:
    """Neither null nor blank nor a text that means none."""
    return ~F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(NO_CONTACT)


def technical_match(f: LeadFilter) -> Column:
    """Tri-state: unknown values fail a wish for true and pass a wish for false; unknown ``ssl`` passes both."""
    tests = [is_true(F.col(n)) if want else ~is_true(F.col(n)) for n in ("tag_manager", "meta_pixel", "seo_errors", "mobile") if (want := getattr(f, n)) is not None]
    if f.ssl is not None:
        tests.append(~F.col("ssl").eqNullSafe(not f.ssl))
    slow = F.coalesce(F.col("load_seconds") > 3, F.lit(False))
    if f.speed is not None:
        tests.append(slow if f.speed == "slow" else ~slow)
    return _all(tests)


def social_match(f: LeadFilter) -> Column:
    """Blank and ``N/D`` profiles are missing; bad reviews are ratings above 0 and below 4."""
    tests = []
    if f.instagram is not None:
        has = ~F.trim(F.coalesce("instagram", F.lit(""))).isin("", "N/D")
        tests.append(has if f.instagram else ~has)
    if f.bad_reviews:
        tests.append(F.coalesce((F.col("rating") > 0) & (F.col("rating") < 4), F.lit(False)))
    return _all(tests)


def business_match(f: LeadFilter, strict: bool = False) -> Column:
    """Unknown amounts (null or 0) pass every bound; with ``strict`` they fail the lower ones. Unknown founding dates pass."""
    tests = []
    for name in ("revenue", "employees"):
        amount = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        low, high = getattr(f, f"{name}_min"), getattr(f, f"{name}_max")
        if low is not None:
            tests.append(amount >= low if strict else (amount <= 0) | (amount >= low))
        if high is not None:
            tests.append(amount <= high)
    born = F.coalesce("founded", F.lit(""))
    if f.founded_after:
        tests.append((born == "") | (born >= f.founded_after))
    if f.founded_before:
        tests.append((born == "") | (born <= f.founded_before))
    return _all(tests)


def lead_match(f: LeadFilter) -> Column:
    return technical_match(f) & social_match(f) & business_match(f)


def strict_lead_match(f: LeadFilter) -> Column:
    """The variant of the audit worker: a wish for no ``ssl`` needs an explicit false; unknown amounts fail lower bounds."""
    tests = [is_true(F.col(n)) if want else ~is_true(F.col(n)) for n in ("tag_manager",) if (want := getattr(f, n)) is not None]
    if f.seo_errors:
        tests.append(is_true(F.col("seo_errors")))
    if f.ssl is not None:
        tests.append(~F.col("ssl").eqNullSafe(False) if f.ssl else F.col("ssl").eqNullSafe(False))
    return _all([*tests, business_match(LeadFilter(revenue_min=f.revenue_min, employees_min=f.employees_min), strict=True)])


def has_contact(phone: Column, email: Column) -> Column:
    """A phone, or a mail address that is not a template's."""
    mail = F.lower(F.trim(F.coalesce(email, F.lit(""))))
    return present(phone) | (F.contains(mail, F.lit("@")) & ~F.split_part(mail, F.lit("@"), F.lit(2)).isin(TEMPLATE_DOMAINS))


def include_exclude(stack: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """All of ``include`` and none of ``exclude``; a null list is empty."""
    have = F.coalesce(stack, F.array().cast("array<string>"))
    return _all([F.array_contains(have, x) for x in include] + [~F.array_contains(have, x) for x in exclude])


def between_known(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Within the bounds that are given; null fails as soon as there is one."""
    tests = [c >= low] * (low is not None) + [c <= high] * (high is not None)
    return F.coalesce(_all(tests), F.lit(False))


def market_match(category: str | None = None, city: str | None = None, min_score: float = 0) -> Column:
    tests = [F.col("score") >= min_score] if min_score > 0 else []
    tests += [F.coalesce(contains_ci(F.col(n), x), F.lit(False)) for n, x in (("category", category), ("city", city)) if x]
    return _all(tests)


def signal_strength(confidence: Column, age_hours: Column, tier: Column) -> Column:
    """Confidence (50 if null), fading to 0 over a week, times 1 for official, 0.5 for inferred and 0.8 for other sources."""
    faded = F.greatest(F.lit(0.0), (F.lit(168) - F.coalesce(age_hours, F.lit(0))) / 168.0)
    weight = F.when(tier == "official", 1.0).when(tier == "inferred", 0.5).otherwise(0.8)
    return clamp(F.coalesce(confidence, F.lit(50)) * faded * weight).cast("long")


def worker_opportunity() -> Column:
    """Points for gaps of a lead, at most 100: pixel, site, profile, search, mail policy, mobile, speed, rating, reviews."""
    points = [
        F.when(~is_true(F.col("meta_pixel")), 25),
        F.when(F.coalesce("site", F.lit("")) == "", 30),
        F.when(F.coalesce("instagram", F.lit("")) == "", 10),
        F.when(is_true(F.col("seo_errors")), 15),
        F.when(F.col("dmarc").eqNullSafe(False), 10),
        F.when(F.col("load_seconds") > 4.0, 5),
        F.when(F.col("rating") < 3.5, 20).when(F.col("rating") < 4.0, 10),
        F.when(F.coalesce("reviews", F.lit(0)) < 10, 5),
    ]
    return F.least(F.lit(100), reduce(Column.__add__, [F.coalesce(p, F.lit(0)) for p in points])).cast("long")


def twin_opportunity() -> Column:
    """The digital twin's points, which differ from the worker's."""
    points = [(~is_true(F.col("meta_pixel")), 25), (F.coalesce("site", F.lit("")) == "", 30), (F.coalesce("instagram", F.lit("")) == "", 15), (is_true(F.col("seo_errors")), 20), (F.col("dmarc").eqNullSafe(False), 10)]
    return F.least(F.lit(100), reduce(Column.__add__, [F.when(test, n).otherwise(0) for test, n in points])).cast("long")


def opportunity(scores: Column, graph_score: Column) -> Column:
    """Mean of structs (score, confidence) by confidence, blended with the graph's score: a quarter, or 0.6 without signals."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x["score"] * x["confidence"])
    weight = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x["confidence"])
    mean, share = F.when(weight > 0, total / weight).otherwise(0.0), F.when(F.size(scores) > 0, 0.25).otherwise(0.6)
    return F.least(F.lit(100), half_up(mean * (1 - share) + graph_score * share)).cast("long")


def merged_stage(current: Column, proposed: Column) -> Column:
    """Stages go forward only; terminal ones stay unless another terminal one is proposed. Unknown ones are the first."""
    rank = F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair])
    known = F.when(current.isin(list(STAGES)), current).otherwise("nuovo")
    forward = F.coalesce(rank[proposed] > rank[known], F.lit(False)) & ~known.isin("vinto", "perso")
    return F.when(proposed.isin("vinto", "perso") | forward, proposed).otherwise(known)


def needs_audit(age_days: Column, site: Column, threshold: int = 40) -> Column:
    """A real site that was never audited or whose freshness is at most the threshold."""
    fresh = clamp(F.lit(100.0) - age_days / 30.0 * 100)
    return present(site) & (age_days.isNull() | (fresh <= threshold))


def phone_kind(phone: Column) -> Column:
    """``mobile`` (3 after an optional 39), ``landline`` (0), else ``other``; ``none`` without a phone."""
    d = F.regexp_replace(F.regexp_replace(phone, "[^0-9]", ""), "^(0039|39)(?=[03])", "")
    return F.when(~present(phone), "none").when(d.startswith("3"), "mobile").when(d.startswith("0"), "landline").otherwise("other")


def gap_text() -> Column:
    """Names of a lead's gaps, comma-joined in fixed order."""
    return F.concat_ws(", ", F.when(~is_true(F.col("meta_pixel")), "pixel"), F.when(~is_true(F.col("tag_manager")), "tag manager"), F.when(F.col("ssl").eqNullSafe(False), "ssl"), F.when(F.col("mobile").eqNullSafe(False), "mobile"), F.when(is_true(F.col("seo_errors")), "seo"))


def revenue_radius(revenue: Column, low: Column, high: Column) -> Column:
    """Radius 6 to 28 by the square root of the place between the bounds."""
    lo = F.greatest(F.lit(1.0), low)
    place = (revenue - lo) / (F.greatest(lo + 1, high) - lo)
    return F.lit(6.0) + F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))) * 22


def score_colour(score: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(score).cast("double"))) / 100
    parts = [half_up(F.lit(220) - t * 96), half_up(F.lit(38) + t * 20), half_up(F.lit(38) + t * 199)]
    return F.concat(F.lit("rgb("), F.concat_ws(",", *[p.cast("long").cast("string") for p in parts]), F.lit(")"))


#: The sixteen gaps that a search can ask for; ``no_site`` is the only one that needs no site.
GAP_TESTS = {
    "seo_errors": lambda: is_true(F.col("seo_errors")),
    "no_pixel": lambda: ~is_true(F.col("meta_pixel")),
    "no_tag_manager": lambda: ~is_true(F.col("tag_manager")),
    "no_ssl": lambda: F.col("ssl").eqNullSafe(False),
    "no_ads": lambda: ~is_true(F.col("google_ads")),
    "no_instagram": lambda: ~present(F.col("instagram")),
    "no_analytics": lambda: ~is_true(F.col("analytics")),
    "slow_site": lambda: F.coalesce(F.col("load_seconds") > 3, F.lit(False)),
    "no_site": lambda: ~present(F.col("site")),
    "no_facebook": lambda: ~present(F.col("facebook")),
    "no_dmarc": lambda: ~is_true(F.col("dmarc")),
    "not_mobile": lambda: ~is_true(F.col("mobile")),
    "no_linkedin": lambda: ~present(F.col("linkedin")),
    "no_email": lambda: ~present(F.col("email")),
    "low_rating": lambda: F.coalesce((F.col("rating") > 0) & (F.col("rating") < 4), F.lit(False)),
    "few_reviews": lambda: F.coalesce((F.col("reviews") >= 0) & (F.col("reviews") < 10), F.lit(False)),
}
#: Gaps of a site; with one of them, and where ``no_site`` is not asked for alone, a lead must have a site.
SITE_GAPS = {"seo_errors", "no_pixel", "no_tag_manager", "no_ssl", "no_ads", "no_analytics", "slow_site", "no_dmarc", "not_mobile"}


def any_gap(names: list[str]) -> Column:
    """Leads with any of the gaps. Where ``no_site`` is among less than all gaps, leads without a site count."""
    asked = reduce(Column.__or__, [GAP_TESTS[n]() for n in names], F.lit(False))
    needs_site = bool(SITE_GAPS & set(names)) and ("no_site" not in names or len(names) == len(GAP_TESTS))
    return asked & present(F.col("site")) if needs_site else asked


def meeting(rows: DataFrame, found: DataFrame, wanted: list[tuple[str, float | None, float | None]]) -> DataFrame:
    """Leads that meet every (kind, least confidence, greatest age in hours); one aggregation of the signals."""
    tests = []
    for kind, confidence, age in wanted:
        test = F.col("kind") == kind
        test = test & (F.col("confidence") >= confidence) if confidence is not None else test
        tests.append(test & (F.col("age_hours") <= age) if age is not None else test)
    met = found.groupBy("lead").agg(*(F.bool_or(t).alias(f"t{n}") for n, t in enumerate(tests)))
    met = met.where(reduce(Column.__and__, [F.col(f"t{n}") for n in range(len(tests))], F.lit(True)))
    return rows.join(met.select("lead"), F.col("id") == F.col("lead"), "left_semi") if wanted else rows


def hits_or_all(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows whose ``id`` is among the hits; all rows where none is. Decided inside the plan, by one row that is broadcast."""
    marked = rows.join(hits.select(F.col("id").alias("_hit")).distinct(), F.col("id") == F.col("_hit"), "left")
    some = rows.join(hits, "id", "left_semi").limit(1).agg((F.count("*") > 0).alias("_some"))
    return marked.join(F.broadcast(some)).where(F.col("_hit").isNotNull() | ~F.col("_some")).drop("_hit", "_some")


def relevant(conflicts: list[str]) -> Column:
    """No word of a conflicting trade in category or name."""
    text = F.lower(F.concat_ws(" ", "name", "category"))
    return ~reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in conflicts], F.lit(False))


# What marks an agency's name.
AGENCY = [r"\bagenzia\b.*\b(marketing|comunicaz|digital|web)", r"\b(marketing|comunicaz|digital)\b.*\bagenzia\b", r"\bdigital\s+marketing\b", r"\bweb\s+agenc", r"\bagency\b", r"\bmarketing\s+italia\b", r"\bpasso\s+al\s+marketing\b", r"\bmedia\s*marketing\b"]


def is_agency(name: Column, category: Column) -> Column:
    kind = F.lower(F.coalesce(category, F.lit("")))
    text = F.lower(F.concat_ws(" ", name, category))
    return (kind.rlike("agenz") & kind.rlike("marketing|comunicaz|pubblicit|digital")) | kind.isin("marketing", "agenzie di marketing", "agenzie marketing") | text.rlike("|".join(AGENCY))


# Words that stand for a sales role.
SALES = r"\bcommerciale\b|\bcommercial\b|\bsales\b|\bvenditor\w*\b|\baccount manager\b"


def role_match(text: Column, roles: list[str]) -> Column:
    """Roles of up to four letters as whole words, sales roles by their own words, others as substrings."""
    t = F.lower(text)

    def one(r: str) -> Column:
        return t.rlike(rf"\b{r}\b") if len(r) <= 4 else t.rlike(SALES) if r in ("commerciale", "commercial") else F.contains(t, F.lit(r))

    return reduce(Column.__or__, [one(r.lower()) for r in roles], F.lit(not roles))


def subtype(text: Column, positives: list[str], negatives: list[str]) -> Column:
    """``match`` with a positive phrase, else ``opposite`` with a negative one, else ``unknown``."""
    phrase = lambda words: F.lower(F.coalesce(text, F.lit(""))).rlike(r"\b(" + "|".join(words) + r")\b")
    return F.when(phrase(positives), "match").when(phrase(negatives), "opposite").otherwise("unknown")


def strict_category(category: Column, wanted: list[str]) -> Column:
    """Whole-phrase match; the last vowel may differ (singular and plural), ``agenzie x`` is ``agenzia di x``."""

    def pattern(w: str) -> str:
        stem = w.lower().strip().removeprefix("agenzie di ").removeprefix("agenzie ").removeprefix("agenzia di ")
        stem = stem[:-1] + "[aeio]?" if stem[-1] in "aeio" else stem + "s?"
        return f"^(agenzi[ae] (di )?)?{stem}$"

    return F.lower(F.trim(category)).rlike("|".join(pattern(w) for w in wanted))


def merge_people(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both sides by ``key`` (of equal keys the least name); blanks of the first are filled by the second."""
    one = first.groupBy("key").agg(F.min_by(F.struct("name", "phone", "title", "size"), "name").alias("a"))
    two = second.groupBy("key").agg(F.min_by(F.struct("name", "phone", "title", "size", "seniority"), "name").alias("b"))
    both = one.join(two, "key", "full")
    n = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    return both.select("key", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("name", "phone", "title", "size")), F.col("b.seniority").alias("seniority"), n.alias("sources"))


def overlay(rows: DataFrame, payload: str, names: list[str]) -> DataFrame:
    """Columns that aren't empty win over the payload's fields of the same names."""
    def shown(n: str) -> Column:
        own = F.nullif(F.col(n), F.lit("")) if dict(rows.dtypes)[n] == "string" else F.col(n)
        return F.coalesce(own, F.col(f"{payload}.{n}")).alias(n)

    return rows.select(*[c for c in rows.columns if c not in names and c != payload], *map(shown, names))


def csv_line(names: list[str]) -> Column:
    """All fields quoted, quotes doubled, null as empty."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for n in names]
    return F.concat_ws(",", *cells)


def new_only(rows: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key (the least ``order``) that no stored row has."""
    return rows.groupBy(key).agg(F.min(order).alias(order)).join(stored.select(key), key, "left_anti")


def names_company(blob: Column, tokens: list[str], site: str) -> Column:
    """The site's first label of four letters or more, or two of the name's tokens (or its only one), in a lower-case text."""
    label = site.split(".")[0]
    hits = reduce(Column.__add__, [F.contains(blob, F.lit(t)).cast("int") for t in tokens], F.lit(0))
    named = (hits >= min(2, len(tokens))) & F.lit(bool(tokens))
    return named | F.contains(blob, F.lit(label)) if len(label) >= 4 else named
