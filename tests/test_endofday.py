"""Ambiguous rows decided by the rows around them, and extractions held against their text."""

import pytest
from pyspark.sql import functions as F

from ledgerlink.functions.similarity import jaro_winkler_of
from ledgerlink.operators import endofday, extraction

ROWS = "row_id string, name string, city string, postal string, address string, has_date boolean"
POOL = "row_id string, pos int, candidate_id string, siren string, score double, hard_veto boolean, c_name string, c_city string, c_postal string, c_address string, active boolean, head boolean"
KNOWN = "row_id string, name string, city string, postal string, address string, candidate_id string, siren string"


def run(spark, rows, pool, known=()):
    df = endofday.reranked(spark.createDataFrame(rows, ROWS).withColumn("lock", F.lit("clash")), spark.createDataFrame(pool, POOL), spark.createDataFrame(list(known), KNOWN))
    return {(r.row_id, r.candidate_id): r for r in df.collect()}


def test_accepted_without_help_and_undecided(spark):
    rows = [("a", "ALPHA", "LYON", "69001", "", True), ("b", "BETA", "PARIS", "75001", "", True), ("b", "BETA", "PARIS", "75001", "", True), ("n", None, None, None, None, None)]
    pool = [("a", 1, "1", "s1", 0.91, False, "ALPHA", "LYON", "69001", "", True, True), ("a", 2, "2", "s2", 0.70, False, "ALFA", "LYON", "69001", "", True, True),
            ("b", 1, "3", "s3", 0.62, False, "BETA", "PARIS", "75001", "", True, True), ("b", 2, "4", "s4", 0.60, False, "BETA", "PARIS", "75001", "", True, True),
            ("n", 1, "9", None, None, None, None, None, None, None, None, None), ("v", 1, "9", "s9", 0.9, True, "", "", "", "", True, True)]
    got = run(spark, rows, pool)
    a = got["a", "1"]
    assert (a.decision, a.eod_score, a.margin, a.chosen) == ("AUTO_ACCEPT", 0.91, 0.21, True)
    assert (got["b", "3"].decision, got["b", "3"].reason) == ("REVIEW_REQUIRED", "MARGIN_TOO_SMALL") and got["b", "3"].eod_score > 0.62
    assert got["n", "9"].decision == "REVIEW_REQUIRED" and ("v", "9") not in got and not got["b", "4"].chosen


def test_priors_add_up(spark):
    rows = [("b", "BETA SARL", "PARIS", "75001", "1 RUE X", False)]
    pool = [("b", 1, "3", "s3", 0.62, False, "BETA", "PARIS", "75002", "2 RUE X", False, True), ("b", 2, "4", "s4", 0.60, False, "GAMMA", "LYON", "69001", "", True, True)]
    known = [("k", "BETA SARL", "PARIS", "75001", "", "3", "s3")]
    r = run(spark, rows, pool, known)["b", "3"]
    name = 0.65 * jaro_winkler_of("BETA", "BETA SARL") + 0.2 * 0.2
    city, geo, time = 0.7 + 0.3 * 0.2, 0.25 + 0.35 + 0.1, 0.45
    assert [r.prior_name, r.prior_city, r.prior_geo, r.prior_time] == pytest.approx([name, city, geo, time])
    assert r.eod_score == pytest.approx(0.62 + 0.04 * name + 0.03 * city + 0.03 * geo + 0.02 * time, abs=1e-4) and (r.top_siren, r.lock) == ("s3", 1.0)


def test_a_locked_siren_rules_others_out(spark):
    rows = [("a", "ALPHA", "LYON", "69001", "", True)]
    pool = [("a", 1, "1", "s1", 0.78, False, "ALPHA", "LYON", "69001", "", True, True), ("a", 2, "2", "s2", 0.75, False, "ALPHA", "LYON", "69001", "", True, True)]
    known = [(f"k{i}", "ALPHA", "LYON", "69001", "", "2", "s2") for i in range(5)]
    got = run(spark, rows, pool, known)
    assert got["a", "1"].eod_score == 0.0 and got["a", "2"].chosen and got["a", "2"].decision == "AUTO_ACCEPT" and got["a", "2"].place == 1


def test_a_branch_goes_first_but_is_not_accepted(spark):
    rows = [("a", "ALPHA", "LYON", "69001", "5 RUE X", True)]
    pool = [("a", 1, "1", "s", 0.82, False, "ALPHA", "PARIS", "75001", "", False, True), ("a", 2, "2", "s", 0.79, False, "ALPHA", "LYON", "69001", "5 RUE X", True, False)]
    pool[0] = (*pool[0][:4], 0.95, *pool[0][5:])
    pool[1] = (*pool[1][:4], 0.93, *pool[1][5:])
    got = run(spark, rows, pool)
    top = next(r for r in got.values() if r.chosen)
    assert top.candidate_id == "2" and top.decision == ("AUTO_ACCEPT" if top.margin >= 0.05 else "REVIEW_REQUIRED")
    far = [("a", 1, "1", "s", 0.95, False, "ALPHA", "PARIS", "75001", "", True, False), ("a", 2, "2", "s", 0.80, False, "ALPHA", "LYON", "69001", "5 RUE X", True, False)]
    assert run(spark, rows, far)["a", "1"].chosen


def test_blank_rows_hang_together_and_empty_tables_pass(spark):
    rows = [("a", "", "", "", "", False), ("b", None, None, None, None, False), ("c", "X", "", "", "", False)]
    pool = [(r, 1, r, f"s{r}", 0.5, False, "", "", "", "", True, True) for r in "abc"]
    got = run(spark, rows, pool)
    assert got["a", "a"].component == got["b", "b"].component != got["c", "c"].component
    assert run(spark, [], []) == {}


def field(value, evidence, confidence=0.9):
    return (value, evidence, confidence)


def test_extractions_are_held_against_their_text(spark):
    schema = "row_id string, row_text string, parse_status string, fields map<string,struct<value:string,evidence_text:string,confidence:double>>, flags string"
    good = {"company_name_raw": field(" Dupont SARL ", "Dupont SARL"), "company_name_core": field("dupont sarl", "Dupont"), "city": field("Nîmes", "Nimes"), "postal_code": field("30-000", "30000", 3.0), "transaction_date": field("02/01/2024", "02/01/2024")}
    bad = {"company_name_raw": field("X", "nowhere"), "postal_code": field("3000", "3000"), "company_name_core": field("SARL", "SARL"), "siren": field("12", "12", None), "city": field("", "x")}
    rows = [("1", "Dupont SARL 30000 Nimes 02/01/2024", "parsed", good, "clash"), ("2", "SARL 3000 12", "parsed", bad, "clash"), ("3", None, None, None, "clash"), ("1", "Dupont SARL 30000 Nimes 02/01/2024", "parsed", good, "clash"), (None, "x", "parsed", good, "clash")]
    got = {r.row_id: r for r in extraction.readiness(extraction.verified(spark.createDataFrame(rows, schema))).collect()}
    assert set(got) == {"1", "2", "3"}
    one = got["1"]
    assert {k: v.value for k, v in one.fields.items() if v.value} == {"company_name_raw": "Dupont SARL", "company_name_core": "DUPONT", "city": "NIMES", "postal_code": "30000", "transaction_date": "2024-01-02"}
    assert (one.parse_status, one.flags, one.fields["postal_code"].confidence, one.next_action, one.readiness) == ("parsed", [], 1.0, "SEARCH", 0.75)
    assert sorted(got["2"].flags) == ["company_name_core:empty_after_normalization", "company_name_raw:evidence_not_in_row", "postal_code:invalid_format", "siren:invalid_format"]
    assert (got["2"].parse_status, got["3"].parse_status, got["3"].next_action, got["3"].readiness) == ("empty", "empty", "NEEDS_MORE_DATA", 0.2)


def test_the_better_of_two_attempts(spark):
    s = "row_id string, invalid_field_count int, v string"
    a, b = spark.createDataFrame([("1", 2, "a"), ("2", 1, "a"), ("3", 0, "a")], s), spark.createDataFrame([("1", 1, "b"), ("2", 1, "b"), ("4", 5, "b")], s)
    assert {r.row_id: r.v for r in extraction.better_attempt(a, b).collect()} == {"1": "b", "2": "a", "3": "a", "4": "b"}


def test_rows_that_stand_for_others(spark):
    """SIRENs of one row stand for those of all rows with the same candidates; the components are those of all rows."""
    rows = spark.createDataFrame([(r, n, "", "", "", True) for r, n in (("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"))], ROWS)
    every = spark.createDataFrame([("a", "s1"), ("b", "s1"), ("a", "s2"), ("b", "s2"), ("c", "s2"), ("d", "s3")], "row_id string, siren string")
    few, same = every.where("row_id <> 'b'"), spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "d")], "row_id string, like string")
    known = endofday.with_keys(spark.createDataFrame([("k", "K", "LYON", "69001", "", "1", "s1")], KNOWN))
    whole, part = endofday.contexts(endofday.with_keys(rows), every, known), endofday.contexts(endofday.with_keys(rows), few, known, same)
    assert sorted(whole[0].collect()) == sorted(part[0].collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d")]
    assert sorted(whole[1].collect()) == sorted(part[1].collect())
