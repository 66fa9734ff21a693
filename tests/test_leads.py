"""Lead functions on rows of nulls, blanks and ties; company matching against all pairs."""

import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lakegraph.functions import leads as L
from lakegraph.operators import ingest as I
from lakegraph.operators import matching as M

MATCH_SCHEMA = "id string, name string, city string, vat string, domain string, phone string"


def test_filters_on_unknown_values(spark):
    row = "cast(null as boolean) tag_manager, cast(null as boolean) meta_pixel, cast(null as boolean) ssl, cast(null as boolean) seo_errors, cast(null as boolean) mobile, cast(null as double) load_seconds, ' ' instagram, cast(null as double) rating, cast(null as double) revenue, 0 employees, cast(null as string) founded"
    unknown = spark.range(1).selectExpr(*[c.strip() for c in row.split(", ")])

    def fits(f, test=L.lead_match):
        return unknown.where(test(f)).count() == 1

    assert fits(L.LeadFilter()) and fits(L.LeadFilter(), L.strict_lead_match)
    assert fits(L.LeadFilter(tag_manager=False)) and not fits(L.LeadFilter(tag_manager=True))
    assert fits(L.LeadFilter(ssl=True)) and fits(L.LeadFilter(ssl=False)) and not fits(L.LeadFilter(ssl=False), L.strict_lead_match)
    assert fits(L.LeadFilter(speed="fast")) and not fits(L.LeadFilter(speed="slow"))
    assert fits(L.LeadFilter(instagram=False)) and not fits(L.LeadFilter(instagram=True)) and not fits(L.LeadFilter(bad_reviews=True))
    assert fits(L.LeadFilter(revenue_min=5, employees_min=5, founded_after="2000")) and not fits(L.LeadFilter(revenue_min=5), L.strict_lead_match)


def test_small_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    def text(s):
        return F.lit(s).cast("string")

    contacts = {(None, None): False, ("N/D", "a@Example.com"): False, (" none ", "a@b.it"): True, ("02 1", None): True, (None, "n/a"): False}
    assert {k: one(L.has_contact(*map(text, k))) for k in contacts} == contacts
    assert [one(L.phone_kind(text(p))) for p in ("+39 333 1", "0039 02 1", "02", "800", "", None)] == ["mobile", "landline", "landline", "other", "none", "none"]
    assert [one(L.signal_strength(F.lit(c).cast("int"), F.lit(a).cast("int"), text(t))) for c, a, t in ((100, 0, "official"), (100, 84, "inferred"), (None, None, None), (90, 500, "official"))] == [100, 25, 40, 0]
    assert [one(L.merged_stage(text(a), text(b))) for a, b in ((None, None), ("vinto", "meeting"), ("vinto", "perso"), ("odd", "meeting"), ("meeting", "contattato"))] == ["nuovo", "vinto", "perso", "meeting", "meeting"]
    none = F.array().cast("array<struct<score:double,confidence:double>>")
    assert one(L.opportunity(none, F.lit(50))) == 30
    assert one(L.needs_audit(F.lit(None).cast("int"), text("a.it"))) and not one(L.needs_audit(F.lit(1), text("a.it"))) and not one(L.needs_audit(F.lit(99), text("N/D")))
    assert one(L.score_colour(F.lit(150))) == "rgb(124,58,237)"


def brute_match(a, b):
    def fold(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x or "") if not unicodedata.combining(c)).lower()

    def toks(x):
        return {w for w in fold(x).split() if len(w) > 1 and w not in M.GENERIC_TOKENS}

    if a["vat"] and b["vat"]:
        return (100.0, True) if a["vat"] == b["vat"] else (0.0, False)
    if a["domain"] and a["domain"] == b["domain"]:
        return 95.0, True
    if a["phone"] and b["phone"] and a["phone"][-10:] == b["phone"][-10:]:
        return 90.0, True
    ta, tb, na, nb = toks(a["name"]), toks(b["name"]), fold(a["name"]), fold(b["name"])
    if not ta:
        return 0.0, False
    if not tb:  # generic names are no candidates by name
        return None, False
    both = len(ta & tb)
    token = 0.0 if both == 0 or both < min(2, len(ta), len(tb)) else both / max(len(ta), len(tb)) * 100
    ratio = 0.0 if not na or not nb else 100.0 if na == nb else 92.0 if na in nb or nb in na else SequenceMatcher(None, na, nb).ratio() * 100
    name = max(token, ratio)
    ca, cb = fold(a["city"]), fold(b["city"])
    if ca and not (cb and (ca in cb or cb in ca)):
        return name / 2, False
    single = len(ta) == 1 and len(sorted(ta)[0]) >= 6
    return name, (name >= 75 and token >= 50) or (name >= 88 and len(ta) >= 2) or (name >= 92 and single)


def test_company_match_against_all_pairs(spark):
    names = ["Rossi Pompe srl", "Rossi Pompe", "Pompe Rossi Milano", "Caffè Città", "Caffe Citta", "Bianchi", "bianchi spa", "srl", None, "", "Verdi Impianti Termici", "Verdi Impianti Elettrici", "Rossi"]
    cities = ["Milano", "Roma", "", None, "Roma Nord"]
    left = [(f"l{i}", n, cities[i % 5], "12345678901" if i % 5 == 4 else None, "rossi.it" if i == 1 else "", "3331234567" if i == 5 else None) for i, n in enumerate(names * 3)]
    right = [(f"r{i}", n, cities[i % 3], "12345678901" if i % 7 == 3 else "10987654321" if i % 7 == 5 else None, "rossi.it" if i == 4 else None, "+39 333 1234567".replace(" ", "") if i == 2 else None) for i, n in enumerate(names * 2)]
    rows = M.match_companies(spark.createDataFrame(left, MATCH_SCHEMA), spark.createDataFrame(right, MATCH_SCHEMA)).collect()
    keys = MATCH_SCHEMA.replace(" string", "").split(", ")
    got = {(r.lead_id, r.record_id): (r.score, r.accepted) for r in rows}
    assert len(got) == len(rows)
    lefts, rights = [dict(zip(keys, x)) for x in left], [dict(zip(keys, x)) for x in right]
    want = {(a["id"], b["id"]): brute_match(a, b) for a in lefts for b in rights}
    for k, (score, accepted) in got.items():
        assert want[k] == (pytest.approx(score), accepted), k
    assert {k for k, (_, ok) in want.items() if ok} == {k for k, (_, ok) in got.items() if ok}
    by_lead = {}
    for r in rows:
        by_lead.setdefault(r.lead_id, []).append(r)
    for lead, found in by_lead.items():
        top = sorted((score for (a, _), (score, _) in want.items() if a == lead and score is not None), reverse=True)
        assert max(r.score for r in found) == pytest.approx(top[0]) or top[0] < 75
        if top[0] >= 75:
            assert {r.ambiguous for r in found} == {top[1] >= 0.85 * top[0]}, lead
    empty = spark.createDataFrame([], MATCH_SCHEMA)
    assert M.match_companies(empty, spark.createDataFrame(right, MATCH_SCHEMA)).isEmpty()


def test_suffixes_and_blanks(spark):
    a = spark.createDataFrame([(1, "a.b.it"), (2, "b.it"), (3, None), (4, "xb.it"), (5, "it")], "id int, host string")
    b = spark.createDataFrame([(7, "b.it"), (8, "c.a.b.it"), (9, None), (9, "b.it")], "id int, host string")
    got = {tuple(r) for r in M.suffix_matches(a, b).collect()}
    assert got == {(1, 7), (2, 7), (1, 8), (2, 8), (1, 9), (2, 9)}
    rows = spark.createDataFrame([(1, "k", " ", "x"), (2, None, None, None), (3, "z", "own", "y")], "id int, a string, phone string, b string")
    known = spark.createDataFrame([("k", "x", "p1"), ("q", "y", "p2")], "a string, b string, phone string")
    assert {r.id: r.phone for r in M.fill_blanks(rows, known, ["a", "b"], ["phone"]).collect()} == {1: "p1", 2: None, 3: "own"}


def test_ingest_and_upsert_on_small_tables(spark):
    schema = "id string, name string, phone string, site string, city string, rating double, employees int, revenue double, load_seconds double, tech_stack array<string>"
    rows = [("1", "B", "N/D", "https://www.x.it/a", "Roma", 4.0, None, None, None, ["ga4"]), ("2", "A", None, "x.it", None, 4.0, 3, None, None, []), ("3", "C", None, "N/D", "Roma", 1.0, 1, 1.0, 1.0, ["ga4"]), ("4", None, None, None, None, None, None, None, None, None)]
    out = I.ingest(spark.createDataFrame(rows, schema))
    assert {(r.id, r.name, r.leads) for r in out["entities"].collect()} == {("x.it", "A", 2), ("tech:ga4", "ga4", 1), ("it:roma", "Roma", 1)}
    assert {tuple(r) for r in out["relationships"].collect()} == {("x.it", "tech:ga4", "uses"), ("x.it", "it:roma", "located_in")}
    assert {tuple(r) for r in out["observations"].collect()} == {("x.it", "rating", 4.0), ("x.it", "employees", 3.0)}
    old = spark.createDataFrame([(1, "a"), (2, None)], "id int, city string")
    new = spark.createDataFrame([(1, None), (3, "c")], "id int, city string")
    assert {tuple(r) for r in I.upsert_entities(old, new, ["city"]).collect()} == {(1, "a", False), (2, None, False), (3, "c", True)}
