"""Column builders over lead records: scores, keys, detectors, page differences. All stay inside Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakegraph.functions.columns import clamp, half_up
from lakegraph.functions.leads import is_true, present

# Points of a severity, and its rank.
SEVERITY_POINTS = {"critical": 34, "high": 24, "medium": 14}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
# Growth points of signal types.
GROWTH = {"hiring": 35, "tender_won": 40, "funding_received": 28, "sector_investment": 18, "registry_change": 12, "executive_change": 10}
# Points of intent rules.
INTENT_PAIR = ("hiring", "crm_change", 35)
INTENT = [(["tender_won"], 25), (["funding_received", "funding_news"], 20), (["hiring"], 15), (["expansion", "new_location"], 15), (["executive_change"], 15), (["website_changed"], 10), (["site_stale"], 5)]
# Marks of customer-relation software in a page or stack.
CRM = {
    "HubSpot": r"\bhubspot\b|js\.hs-scripts\.com|hsforms\.net",
    "Salesforce": r"\bsalesforce\b|force\.com|pardot\.com",
    "Pipedrive": r"\bpipedrive\b|pipedriveassets\.com",
    "Zoho CRM": r"\bzoho\b|zohopublic\.com|zcrm",
    "Microsoft Dynamics": r"\bdynamics\s*365\b|dynamics\.com",
    "Freshsales": r"\bfreshsales\b|freshworks\.com",
}
# What a reply says, in order of precedence, with its confidence.
REPLIES = [
    ("unsubscribe", r"\b(unsubscribe|opt.?out|rimuov|non contatt|stop email|cancell.*iscriz|gdpr|privacy.*rimuov)\b", 92),
    ("wrong_person", r"\b(non sono|persona sbagliata|wrong person|non compet|referente|collega giusto|inoltro a)\b", 85),
    ("not_interested", r"\b(non interess|no grazie|non mi interessa|lascia perdere|non proced|passo|declino)\b", 88),
    ("interested", r"\b(interessat|mandami|inviami|call|telefon|videochiam|appuntament|ok proced|perfetto parliam|quando possiamo)\b", 86),
]
# Marks of page features.
CHATBOTS = ["tidio.co", "tidiochat", "intercom.io", "intercomcdn.com", "widget.intercom", "crisp.chat", "crisp.", "tawk.to", "zendesk", "zopim", "livechatinc", "smartsupp", "chatbase", "botpress"]
BOOKINGS = ["calendly.com", "treatwell", "thefork", "fork-cdn", "youcanbook", "youcanbook.me"]
SHOPS = ["shopify", "cdn.shopify.com", "woocommerce", "wp-content/plugins/woocommerce", "magento"]
DECIDERS = ["p.iva", "partita iva", "titolare", "dott.", "avv.", "amministratore", "ceo", "founder"]
# Event type of a signal type; the two ingest paths differ in the last.
SIGNAL_EVENTS = {
    "hiring": "new_hiring", "new_hiring": "new_hiring", "registry_change": "registry_change", "funding_news": "funding_received", "funding_received": "funding_received",
    "site_stale": "website_changed", "website_changed": "website_changed", "meta_ads_started": "pixel_installed", "google_ads_started": "ads_started", "ads_started": "ads_started",
    "crm_detected": "crm_installed", "crm_installed": "crm_installed", "tender_won": "tender_won", "sector_investment": "sector_investment", "revenue_changed": "revenue_changed",
    "employees_changed": "employees_changed", "new_location": "registry_change", "expansion": "registry_change", "partnership": "registry_change", "acquisition": "registry_change",
    "price_change": "registry_change", "executive_change": "new_director",
}
WORKER_SIGNAL_EVENTS = {k: SIGNAL_EVENTS[k] for k in ("hiring", "new_hiring", "registry_change", "funding_news", "funding_received", "site_stale", "website_changed", "meta_ads_started", "crm_detected")} | {"google_ads_started": "crm_installed"}
# Words for entrepreneurs and for the professions in a job title.
OWNERS = ["owner", "founder", "titolare", "proprietario", "ceo", "imprenditore", "co-founder", "socio"]
PROFESSIONS = ["libero professionista", "freelance", "consulente", "avvocato", "commercialista", "architetto", "ingegnere", "medico", "notaio", "dentista"]


def any_of(text: Column, marks: list[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in marks])


def points(test: Column, n) -> Column:
    return F.when(test, n).otherwise(0)


def severity_weight(severity: Column | str, confidence: Column | int) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    base = F.create_map(*[F.lit(x) for pair in SEVERITY_POINTS.items() for x in pair])[severity]
    return (base + half_up((F.lit(confidence) if isinstance(confidence, int) else confidence) * 0.18)).cast("long")


def buying_signals() -> Column:
    """Array of (id, severity, confidence, points) for a lead row with its audit; unknown values count as missing."""
    ads, pixel, gtm, analytics = (is_true(F.col(c)) for c in ("google_ads", "meta_pixel", "tag_manager", "analytics"))
    contact = present(F.col("phone")) | present(F.col("email"))
    bare = ~gtm & ~analytics & ~pixel
    no_capture = F.coalesce((F.col("forms") == 0) & ~F.col("clickable"), F.lit(False))
    slow = F.coalesce(F.col("performance") < 50, F.lit(False))
    running = F.coalesce(F.col("active_ads") > 0, F.lit(False))
    structured = F.col("vat").isNotNull() | F.coalesce(F.col("employees") >= 6, F.lit(False)) | F.col("revenue").isNotNull()
    rating, reviews, load = F.col("rating"), F.col("reviews"), F.col("load_seconds")
    broken, infra = no_capture | slow | bare, pixel | ads
    found = [
        ("active_meta_ads_broken_funnel", running & broken, "critical", F.lit(98)),
        ("active_meta_ads_running", running & ~broken, "high", F.lit(94)),
        ("paid_infra_without_capture", infra & no_capture, "critical", F.lit(96)),
        ("measured_slow_site", slow, F.when(infra, "critical").otherwise("high"), F.when(infra, 91).otherwise(80)),
        ("pixel_without_measurement", pixel & ~analytics & ~gtm, "high", F.lit(84)),
        ("paid_traffic_without_tracking", ads & ~(gtm & analytics & pixel), "critical", F.when(bare, 94).otherwise(88)),
        ("structured_company_tracking_gap", structured & bare, "high", F.when(F.col("vat").isNotNull(), 86).otherwise(76)),
        ("slow_site_conversion_risk", (load >= 4) & (ads | contact | rating.isNotNull()), F.when(ads, "critical").otherwise("high"), F.when(ads, 90).otherwise(78)),
        ("strong_reputation_under_monetized", (rating >= 4.2) & (reviews >= 20) & bare, "high", F.lit(82)),
        ("contact_friction", present(F.col("site")) & ~contact, "medium", F.lit(68)),
        ("paid_traffic_landing_leak", ads & (load >= 3.2) & bare, "critical", F.lit(92)),
        ("local_reputation_social_gap", ~present(F.col("instagram")) & ~present(F.col("facebook")) & (rating >= 4) & (reviews >= 15), "medium", F.lit(72)),
        ("trust_blocker_no_ssl", F.col("ssl").eqNullSafe(False), "high", F.lit(84)),
    ]

    def one(name: str, test: Column, severity, confidence: Column) -> Column:
        level = F.lit(severity) if isinstance(severity, str) else severity
        return F.when(test, F.struct(F.lit(name).alias("id"), level.alias("severity"), confidence.cast("long").alias("confidence"), severity_weight(level, confidence).alias("points")))

    return F.filter(F.array(*[one(*x) for x in found]), lambda x: x.isNotNull())


def buying_score(signals: Column) -> Column:
    return clamp(F.aggregate(signals, F.lit(0).cast("long"), lambda s, x: s + x["points"])).cast("long")


def heat_label(score: Column) -> Column:
    return F.when(score >= 80, "caldissimo").when(score >= 60, "caldo").when(score >= 35, "interessante").otherwise("freddo")


def maturity() -> dict[str, Column]:
    """Digital maturity, its label, deal range and urgency of a lead row.

    The range adds up the printed estimates as the reference reads them: a dot in an amount counts as a decimal point.
    """
    pixel, gtm, ads, analytics = (is_true(F.col(c)) for c in ("meta_pixel", "tag_manager", "google_ads", "analytics"))
    ssl, seo, slow = ~F.col("ssl").eqNullSafe(False), is_true(F.col("seo_errors")), F.coalesce(F.col("load_seconds") > 3, F.lit(False))
    social = F.coalesce(F.trim("instagram"), F.lit("")) != ""
    score = F.lit(30) + points(pixel, 15) + points(gtm, 12) + points(ads, 12) + points(analytics, 10) + points(ssl, 6) + points(~seo, 5) + 4 + points(~slow, 3) + points(social, 3)
    score = F.least(F.lit(100), score).cast("long")
    # Each gap: critical, high, least and greatest amount.
    gaps = [
        (~pixel & ~gtm & ~ads & ~analytics, 1, 0, 2.0, 5.0), (~pixel, 0, 1, 500.0, 2.0), (~gtm, 0, 1, 300.0, 800.0), (~ads, 0, 1, 500.0, 3.0), (~analytics, 1, 0, 300.0, 600.0),
        (~ssl, 1, 0, 100.0, 300.0), (seo, 0, 1, 800.0, 2.5), (slow, 0, 0, 500.0, 1.5), (~social & (F.coalesce("category", F.lit("")) != ""), 0, 0, 300.0, 1.5),
    ]
    critical, high, low, most = (reduce(Column.__add__, [points(g[0], g[i]) for g in gaps]) for i in (1, 2, 3, 4))
    return {
        "maturity": score,
        "label": F.when(score >= 80, "Avanzato").when(score >= 55, "Intermedio").when(score >= 30, "Base").otherwise("Critico"),
        "deal_min": low.cast("double"),
        "deal_max": most.cast("double"),
        "urgency": F.when(critical >= 2, "alta").when((critical >= 1) | (high >= 2), "media").otherwise("bassa"),
    }


def score_factors() -> Column:
    """Array of (factor, points, active): why a lead scores as it does."""
    mail = F.coalesce(F.trim("email"), F.lit("")) != ""
    rows = [
        ("No Facebook Pixel", 25, ~is_true(F.col("meta_pixel"))), ("No Google Tag Manager", 15, ~is_true(F.col("tag_manager"))), ("Ha Email", 20, mail), ("Errori SEO", 15, is_true(F.col("seo_errors"))),
        ("Sito Lento (>3s)", 10, F.coalesce(F.col("load_seconds") > 3, F.lit(False))), ("No SSL", 10, F.col("ssl").eqNullSafe(False)), ("No Google Ads", 5, ~is_true(F.col("google_ads"))),
    ]
    return F.array(*[F.struct(F.lit(n).alias("factor"), F.lit(p).cast("long").alias("points"), t.alias("active")) for n, p, t in rows])


def market_maturity(types: Column) -> Column:
    """Digital maturity for the market map, of a lead row and the set of its signal types."""
    has = lambda t: F.array_contains(types, t)
    n = F.size(F.coalesce("tech_stack", F.array().cast("array<string>")))
    score = F.lit(20) + points(has("google_ads_started") | is_true(F.col("google_ads")), 18) + points(has("meta_ads_started"), 12) + points(has("crm_detected"), 20) + points(~has("site_stale"), 10)
    score = score + F.when(n >= 4, 12).when(n >= 2, 6).otherwise(0) + F.coalesce(F.least(F.lit(15), half_up(F.col("performance") / 5)), F.lit(0)) + points(F.col("site").isNotNull(), 8)
    return clamp(score).cast("long")


def growth_rate(types: Column) -> Column:
    return clamp(reduce(Column.__add__, [points(F.array_contains(types, t), w) for t, w in GROWTH.items()])).cast("long")


def intent_score(types: Column, recent: Column, mean_strength: Column, pairs: Column) -> Column:
    """Rule points of the signal types, times 1.2 from three recent signals on, the mean strength, and the pairs' factor."""
    has = lambda t: F.array_contains(types, t)
    base = points(has(INTENT_PAIR[0]) & has(INTENT_PAIR[1]), INTENT_PAIR[2])
    for names, n in INTENT:
        base = base + points(reduce(Column.__or__, [has(x) for x in names]), n)
    return F.least(F.lit(100), half_up(base * F.when(recent >= 3, 1.2).otherwise(1.0) * mean_strength / 100 * pairs)).cast("long")


def merge_quality() -> Column:
    """Quality of a lead row for the worker's merge."""
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", ""))
    mail = ~F.lower(F.trim(F.coalesce("email", F.lit("")))).isin("", "n/d", "n/a", "none", "null")
    tech = F.when(F.col("pending"), -200).when(F.size("tech_stack") > 0, 80).otherwise(0)
    return (tech + points(mail, 25) + points(digits >= 8, 15) + points(F.col("load_seconds").isNotNull(), 35) + points(F.col("audited_days").isNotNull(), 15)).cast("long")


def dedupe_quality() -> Column:
    """Quality of a lead row for the list's deduplication."""
    real = lambda c: ~F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).isin("", "N/D", "N/A", "N.D.", "n/d", "none", "null", "-")
    digits = F.length(F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", ""))
    total = points(digits >= 8, 100) + points(F.contains(F.coalesce("email", F.lit("")), F.lit("@")), 100) + points(F.size("tech_stack") > 0, 80) + points(F.col("load_seconds").isNotNull(), 10)
    for c in ("site", "instagram", "rating"):
        total = total + points(real(c), 1)
    return F.when(F.col("pending"), -500).otherwise(total).cast("long")


def plain_url(raw: Column) -> Column:
    """Lower case without scheme, ``www.`` and closing slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(raw)), "^https?://", ""), "/+$", ""), r"^www\.", "")


def linkedin(raw: Column) -> Column:
    """``linkedin.com`` and the path of a person or company; null for anything else."""
    path = F.regexp_replace(F.regexp_extract(F.lower(F.trim(raw)), r"^https?://[^/?#]+(/[^?#]*)", 1), "/$", "")
    return F.when(path.rlike("^/(in|company)/"), F.concat(F.lit("linkedin.com"), path))


def stable_key() -> Column:
    """Key of a lead row: web domain, else the last nine digits of its first real phone, else name and city."""
    domain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("site", F.lit("")))), "^https?://", ""), r"^www\.", ""), "/.*$", "")
    parts = F.transform(F.split(F.coalesce("phone", F.lit("")), r"[/,;|]+"), lambda p: F.regexp_replace(F.regexp_replace(p, "[^0-9]", ""), "^(39|0039)", ""))
    phone = F.get(F.filter(parts, lambda p: F.length(p) >= 8), 0)
    slug = lambda c, n: F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, n)
    name, city = slug("name", 40), slug("city", 30)
    key = F.when(domain != "", F.concat(F.lit("web:"), domain)).when(phone.isNotNull(), F.concat(F.lit("tel:"), F.right(phone, F.lit(9))))
    return key.when((name != "") & (city != ""), F.concat_ws(":", F.lit("name"), name, city)).when(name != "", F.concat(F.lit("name:"), name)).otherwise("uid:orphan:lead")


def search_key() -> Column:
    """Key of a search result: site, phone, mail, first forty characters of the name."""
    site = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce("site", F.lit("")))), "^https?://", ""), r"^www\.", ""), "/$", "")
    digits, mail = F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", ""), F.lower(F.trim(F.coalesce("email", F.lit(""))))
    name = F.substring(F.lower(F.trim("name")), 1, 40)
    return F.when(~site.isin("", "n/d", "n/a"), F.concat(F.lit("site:"), site)).when(F.length(digits) >= 8, F.concat(F.lit("phone:"), digits)).when(F.contains(mail, F.lit("@")), F.concat(F.lit("email:"), mail)).otherwise(F.concat(F.lit("name:"), name))


def graph_key() -> Column:
    """Key of a graph result: domain, last nine digits, name and city."""
    digits = F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", "")
    domain = F.split_part(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("site", F.lit(""))), "^https?://", ""), r"^www\.", ""), F.lit("/"), F.lit(1))
    return F.when(domain != "", F.concat(F.lit("web:"), domain)).when(F.length(digits) >= 8, F.concat(F.lit("tel:"), F.right(digits, F.lit(9)))).otherwise(F.concat_ws(":", F.lit("name"), F.substring(F.lower(F.trim("name")), 1, 40), F.lower(F.trim("city"))))


def crm_key() -> Column:
    """Key of a record sent to a customer-relation system: mail, site, name."""
    mail, site = F.lower(F.trim(F.coalesce("email", F.lit("")))), F.lower(F.trim(F.coalesce("site", F.lit(""))))
    return F.when(mail != "", F.concat(F.lit("email:"), mail)).when(site != "", F.concat(F.lit("site:"), site)).otherwise(F.concat(F.lit("name:"), F.lower(F.trim("name"))))


def crm_stack(text: Column) -> Column:
    """Names of the customer-relation software that a text shows."""
    return F.array_compact(F.array(*[F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){p}"), name) for name, p in CRM.items()]))


def reply_intent(text: Column) -> tuple[Column, Column]:
    """Intent and confidence of a reply by the first rule that fits; ``unknown`` with 40 where none does, null for a blank reply."""
    t = F.lower(F.coalesce(text, F.lit("")))
    intent, sure = F.when(F.trim(t) == "", None), F.when(F.trim(t) == "", None)
    for name, pattern, n in REPLIES:
        intent, sure = intent.when(t.rlike(pattern), name), sure.when(t.rlike(pattern), n)
    return intent.otherwise("unknown"), sure.otherwise(40).cast("long")


def audit_stack() -> Column:
    """Present and missing tools of an audited lead row; each once."""
    stack = F.array_join(F.coalesce("tech_stack", F.array().cast("array<string>")), " ")
    builder = F.when(F.contains(stack, F.lit("wordpress")), "WORDPRESS").when(F.contains(stack, F.lit("shopify")), "SHOPIFY").when(F.contains(stack, F.lit("wix")), "WIX")
    pixel, gtm, ads = (is_true(F.col(c)) for c in ("meta_pixel", "tag_manager", "google_ads"))
    tools = [
        builder, F.when(~F.col("ssl").eqNullSafe(False), "SSL"), F.when(pixel, "Meta Pixel").otherwise("MISSING FB PIXEL"), F.when(gtm, "GTM").otherwise("MISSING GTM"),
        F.when(ads, "GOOGLE ADS").otherwise("MISSING GOOGLE ADS"), F.when(F.col("load_seconds") > 4, "SITO LENTO"),
    ]
    return F.array_compact(F.array(*tools))


def plain_diff(text: Column) -> Column:
    """First 4000 characters with years and dates made alike, without the first mention of cookies."""
    s = F.regexp_replace(F.substring(text, 1, 4000), r"\b20\d{2}\b", "YYYY")
    s = F.regexp_replace(s, r"\b\d{1,2}[/:-]\d{1,2}[/:-]\d{2,4}\b", "DATE")
    first = F.regexp_extract(s, "(?is)^(.*?)(?:cookie|gdpr|consent|accetta)", 1)
    rest = F.regexp_extract(s, "(?is)^.*?(?:cookie|gdpr|consent|accetta)(.*)$", 1)
    return F.when(s.rlike("(?i)cookie|gdpr|consent|accetta"), F.concat(first, rest)).otherwise(s)


def novel_terms(before: Column, after: Column, most: int = 6) -> Column:
    """The first words of over four letters that only the later text has."""
    long_words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 4)
    return F.slice(F.filter(long_words(after), lambda w: ~F.array_contains(long_words(before), w)), 1, most)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of an object with sorted keys; strings escaped, nulls kept."""
    parts = [F.concat(F.lit(f'"{k}":'), F.coalesce(v, F.lit("null"))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def json_string(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def cache_key(kind: str, payload: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(payload, 256), 1, 32))


def page_audit(html: Column) -> dict[str, Column]:
    """Flags of a page; null pages have nothing."""
    h = F.coalesce(html, F.lit(""))
    low = F.lower(h)
    mail = F.regexp_extract(h, r"(?i)mailto:([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})", 1)
    named = F
    for d in DECIDERS:
        named = named.when(F.contains(low, F.lit(d)), d.upper())
    title, h1 = h.rlike(r"(?i)<title[^>]*>\s*[^<\s]"), h.rlike(r"(?i)<h1[^>]*>\s*[^<\s]")
    return {
        "has_title": title,
        "has_h1": h1,
        "has_description": h.rlike(r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']\s*[^"'\s]"""),
        "has_viewport": h.rlike(r"""(?i)<meta[^>]*name=["'][^"']*viewport"""),
        "mixed_content": h.rlike(r"""(?i)<(?:script|img)[^>]*src=["']http://|<link[^>]*href=["']http://"""),
        "has_google_ads": h.rlike(r"\bAW-[A-Z0-9]+\b"),
        "has_ga4": h.rlike(r"\bG-[A-Z0-9]+\b"),
        "has_chatbot": any_of(low, CHATBOTS),
        "has_booking": any_of(low, BOOKINGS),
        "has_shop": any_of(low, SHOPS),
        "has_instagram": F.contains(low, F.lit("instagram.com")),
        "has_gtm": F.contains(low, F.lit("googletagmanager.com")),
        "decision_maker": F.when(mail != "", mail).otherwise(named.otherwise("N/D")),
        "seo_disaster": ~(title & h1),
    }


def stale_signals(this_year: int) -> Column:
    """Array of (id, severity, confidence) that tell of an old site; none without a site."""
    year, load = F.col("copyright_year"), F.col("load_seconds")
    fresh = clamp(F.lit(100.0) - F.col("audited_days") / 30.0 * 100)
    rows = [
        ("site_stale_copyright", year <= this_year - 2, F.when(year <= this_year - 4, "high").otherwise("medium"), 82),
        ("site_stale_slow", load >= 4.5, F.when(load >= 6, "high").otherwise("medium"), 78),
        ("site_stale_audit_age", (fresh > 0) & (fresh <= 25), F.when(fresh <= 10, "high").otherwise("medium"), 70),
    ]
    found = [F.when(t & present(F.col("site")), F.struct(F.lit(n).alias("id"), s.alias("severity"), F.lit(c).cast("long").alias("confidence"))) for n, t, s, c in rows]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def employment(title: Column, seniority: Column) -> Column:
    t, s = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(seniority, F.lit("")))
    kind = F.when(title.isNull() & seniority.isNull(), None).when(any_of(t, OWNERS), "Imprenditore").when(any_of(t, PROFESSIONS), "Libero Professionista / P.IVA")
    return kind.when(s.isin("owner", "founder", "c_suite"), "Imprenditore").when(s.isin("director", "vp", "manager"), "Dirigente / Manager").otherwise("Dipendente")


def potential(kind: Column, size: Column) -> Column:
    owner = kind.eqNullSafe("Imprenditore")
    out = F.when(owner & (size > 20), "5.000 - 15.000 €/anno").when(owner & (size > 5), "2.500 - 8.000 €/anno").when(owner, "1.500 - 4.000 €/anno")
    return out.when(kind.eqNullSafe("Libero Professionista / P.IVA"), "1.000 - 3.000 €/anno").when(size > 50, "10.000+ €/anno").otherwise("500 - 2.000 €/anno")


def outbound_play(types: Column, score: Column) -> Column:
    """The play to start: hot leads, then tenders, then hiring; null where none is due."""
    has = lambda t: F.array_contains(types, t)
    return F.when(score >= 80, "hot_lead_play").when(has("tender_won") & (score >= 60), "tender_play").when(has("hiring") & (score >= 50), "hiring_play")


def event_of_signal(kind: Column, worker: bool = False) -> Column:
    """Event type of a signal type, null for one that has none; the worker's table differs."""
    table = WORKER_SIGNAL_EVENTS if worker else SIGNAL_EVENTS
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(kind)]


def scrape_exhausted(status: Column, shown: Column, most: Column, stale: Column, raw: Column, limit: int = 3) -> Column:
    """Whether a scrape has nothing more to give."""
    ended = F.lower(status).isin("completed", "error")
    return F.when(ended, shown < most).otherwise(((stale >= limit) & (raw > 0)) | (stale >= 2 * limit))
