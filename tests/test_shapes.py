"""Flat forms of JSON, VAT answers, planning and resolution on small cases."""

import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlink.functions import planning as P
from ledgerlink.functions import shapes as H
from ledgerlink.functions import similarity as S
from ledgerlink.functions import vat as V
from ledgerlink.operators import registry as R
from ledgerlink.operators import resolve as Z

DEEP = {"a": [{"b": 1, "c": None}, {"b": "x"}], "d": {}, "e": [], "f": [1, "y"], "g": True, "_raw": {"z": 1}}


def test_four_ways_to_flatten():
    assert dict(H.by_records(DEEP)) == {"a_0_b": "1", "a_0_c": "", "a_1_b": "x", "d": "", "e": "", "f": '[1, "y"]', "g": "true", "_raw_z": "1"}
    assert dict(H.by_leaves(DEEP)) == {"a_0_b": "1", "a_0_c": "", "a_1_b": "x", "f_0": "1", "f_1": "y", "g": "true", "_raw_z": "1"}
    assert dict(H.for_columns({"a": {"b": 1, "_raw": 2}, "c": [1], "n": None})) == {"a.b": "1", "c": "[1]", "n": ""}
    assert H.for_details(DEEP) == [("a[0].b", "1"), ("a[0].c", "-"), ("a[1].b", "x"), ("e", "-"), ("f[0]", "1"), ("f[1]", "y"), ("g", "Oui")]


def test_flat_of_odd_bodies(spark):
    deep = '{"a":' * 50_000
    df = spark.createDataFrame([(1, json.dumps(DEEP)), (2, None), (3, ""), (4, "[1]"), (5, "{"), (6, deep), (7, "{}")], "id int, body string")
    got = {r.id: r.x for r in df.select("id", H.flat(F.col("body"), "leaves").alias("x")).collect()}
    assert len(got[1]) == 7 and got[7] == [] and [got[i] for i in (2, 3, 4, 5, 6)] == [None] * 5
    assert df.limit(0).select(H.flat(F.col("body"), "leaves")).count() == 0


def test_labels_and_pruned_fields():
    assert H.snake("codePostalEtablissement") == "code_postal_etablissement"
    assert H.label("etablissement_periodesEtablissement_0_dateDebut") == "Periodes etablissement date debut"
    assert H.pruned(["a.0.b", "c.b", " d ", "e.f.1", ""]) == ["b", "d", "f"]


def answers(spark, payloads, nested=False):
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string").select("i", F.try_parse_json("p").alias("p"))
    return df.select("i", *[c.alias(k) for k, c in V.register_answer(F.col("p"), F.lit("FR"), F.lit("1"), nested).items()]).orderBy("i").collect()


def test_validity_is_told_twice(spark):
    got = answers(spark, ['{"isValid":"false"}', '{"isValid":null,"valid":true}', '{"valid":true}', '{"is_valid":1}', '{"isValid":0}', "{}", None, "no json", '{"isValid":true,"userError":"DOWN"}', '{"isValid":""}'])
    assert [(r.status, r.is_valid) for r in got] == [("VALID", "No"), ("INVALID", "No"), ("VALID", "Yes"), ("VALID", "Yes"), ("INVALID", "No"), ("INVALID", "No"), ("INVALID", "No"), ("INVALID", "No"), ("DOWN", "Yes"), ("INVALID", "No")]
    assert all(r.original_vat_number == "FR1" for r in got)


def test_names_within_names(spark):
    body = '{"name":" ","trader":{"name":"A"},"company":{"address":"B"}}'
    assert [r.legal_name for r in answers(spark, [body])] == [""]
    assert [(r.legal_name, r.registered_address) for r in answers(spark, [body], True)] == [("A", "B")]


def test_vat_texts(spark):
    df = spark.createDataFrame([("fr 12345678901", ""), ("FR1", "fr"), ("12", "FRA"), ("fra12", "FRA"), (None, None), ("F1", "")], "v string, c string")
    assert [tuple(r) for r in df.select(*V.interactive_split(F.col("v"), F.col("c"))).collect()] == [("FR", "12345678901"), ("FR", "1"), ("FRA", "12"), ("FRA", "12"), ("", ""), ("", "F1")]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(V.masked(F.lit(" fr+1*-é2"))) == "FR+1*2" and one(V.french(F.lit("ref fr12345678901 x"))) == "FR12345678901"
    assert one(V.shown_number(F.lit("FR"), F.lit("fr1"), F.lit("x"))) == "fr1" and one(V.shown_number(F.lit("FR"), F.lit("1"), F.lit("x"))) == "FR1" and one(V.shown_number(F.lit(None), F.lit(""), F.lit("x"))) == "x"
    assert one(V.address_lines(F.lit("a\r\n\n b "))) == ["a", "b"]
    assert [one(V.validity(F.lit(x))) for x in ("Yes", "0", "other", "", None)] == [True, False, True, False, False]


def test_row_planning(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    cells = F.array(F.lit("12345678901234"), F.lit("e 123456789"), F.lit(None).cast("string"))
    assert (one(P.exact_ids(cells)[0]), one(P.exact_ids(cells)[1])) == ("12345678901234", "123456789")
    words = F.array(F.lit("SARL Dupont, 123456789 de"), F.lit("FACTURE/ab-Dupont"))
    assert [one(P.row_words(words, k)) for k in ("identity", "supporting", "noise")] == [[], ["SARL", "Dupont"], ["123456789", "de", "FACTURE", "ab"]]
    assert one(P.acronym(F.lit("SARL Bon Pain Rapide"))) == "BPR" and one(P.acronym(F.lit("SARL Bon"))) == ""
    assert one(P.canonical_postal(F.lit(None).cast("string"))) == "00000" and one(P.canonical_department(F.lit("97410"))) == "974"
    assert one(P.leading_number(F.lit("12.5 rue"), 0.0)) == 12.5 and one(P.leading_number(F.lit("rue"), -1.0)) == -1.0
    assert one(P.escape_search(F.lit("L'Été (a+b)"))) == "L Ete \\(a b\\)"


def test_resolution(spark):
    reg = spark.createDataFrame([("2", "s", True), ("1", "s", False), ("9", "t", None), ("0", None, True)], "siret string, siren string, etablissementSiege boolean")
    rows = spark.createDataFrame([("a", "s"), ("b", "t"), ("c", "u"), ("d", None), ("a", "s")], "id string, s string")
    got = sorted(tuple(r) for r in Z.by_siren(rows, reg, F.col("s")).select("id", "siret", "candidate_count", "several").collect())
    assert got == [("a", "2", 2, True), ("a", "2", 2, True), ("b", "9", 1, False), ("c", None, None, None), ("d", None, None, None)]
    x = spark.createDataFrame([("a", "2"), ("a", "1")], "id string, siret string")
    y = spark.createDataFrame([("a", "0"), ("b", "5")], "id string, siret string")
    assert sorted(tuple(r) for r in Z.first_resolved({"x": x, "y": y}, "id", "siret").collect()) == [("a", "1", "x"), ("b", "5", "y")]
    assert sorted(tuple(r) for r in Z.merged([x, y], ["id"]).collect()) == [("a", 1), ("b", 2)]
    assert Z.visible_columns(["a", "b"], ["c"], ["b"]) == ["b"]


def test_lookups_of_nulls_and_keys(spark):
    asked = spark.createDataFrame([(None, None), ("FR", "1"), (None, "1"), ("FR", "1")], "country string, number string")
    register = spark.createDataFrame([("FR", "1", True)], "country string, number string, is_valid boolean")
    assert sorted(r.vat_status for r in R.vat_enriched(asked, register).collect()) == ["INVALID_INPUT", "MISSING_VAT", "VALID", "VALID"]
    reg = spark.createDataFrame([("00012345678901",)], "siret string")
    up = spark.createDataFrame([("12345678901",), ("12345678901 x9",), ("012345678901",), (None,), ("12345678901234",)], "k string")
    got = {r.k: (r.status, r.used_siret) for r in R.enriched(up, reg, F.col("k")).collect()}
    assert got == {"12345678901": ("INVALID_SIRET", "12345678901"), "12345678901 x9": ("INVALID_SIRET", "123456789019"), "012345678901": ("OK", "00012345678901"), None: ("SKIPPED", ""), "12345678901234": ("NOT_FOUND", "12345678901234")}


def test_latest_lets_a_key_filter_reach_the_scan(spark):
    etab = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "siret string, delivery_id bigint, dateDernierTraitementEtablissement timestamp")
    plan = R.latest(etab).where("siret = 'a'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") > plan.index("Aggregate") and R.latest(etab).columns == etab.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="abcé𝄞", min_size=1, max_size=9), st.text(alphabet="abcé𝄞", min_size=1, max_size=9)), min_size=1, max_size=9))
def test_jaro_winkler_in_blocks(pairs):
    assert np.allclose(S.jaro_winkler_block([a for a, _ in pairs], [b for _, b in pairs]), [S.jaro_winkler_of(a, b) for a, b in pairs])


def test_text_decoded_wrongly_once(spark):
    from ledgerlink.functions import normalize as N

    cases = {"CafÃ©": "Café", "Café": "Café", "Ã": "Ã", "plain": "plain", "": "", None: None, "Â€x": "Â€x"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", N.mojibake(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == cases


def test_resolution_confidence(spark):
    from ledgerlink.operators import decisions as D

    schema = "id string, tier string, name string, postal string, city string, department string, c_name string, c_postal string, c_city string, api_score double, n_candidates int"
    rows = [("exact", "siret", "ALPHA", "75001", "Paris", "75", "ALPHA", "75001", "PARIS", 100.0, 1), ("many", "tier2", "ALPHA BETA", "75001", None, "75", "ALPHA", "75002", "PARIS", None, 3), ("none", None, None, None, None, None, None, None, None, None, None), ("sea", "tier5", "X", "97400", "", "974", "Y", "97400", "", None, 1)]
    got = {r.id: (r.confidence, r.band, r.needs_review) for r in D.resolution_confidence(spark.createDataFrame(rows, schema)).collect()}
    assert got["exact"] == (1.0, "HIGH", False)
    assert got["many"] == (0.4, "LOW", True)  # .33 + .06 + .18 / 2 - .08
    assert got["none"] == (0.0, "LOW", True)
    assert got["sea"] == (0.26, "LOW", True)  # .12 + .14: departments of three digits never agree
