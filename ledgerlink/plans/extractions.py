"""Verified extractions, and ambiguous rows ranked by the rows around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N
from ledgerlink.operators import decisions as D
from ledgerlink.operators import endofday as E
from ledgerlink.operators import extraction as X
from ledgerlink.plans.registry import query
from ledgerlink.plans.scalars import base, tidy
from ledgerlink.session import cut, table

C = F.col
VALUE = "trim(fields['{0}'].value)"
TESTED = rf"""case f when 'siren' then case when length(regexp_replace(v, '[^0-9]', '', 'g')) = 9 then regexp_replace(v, '[^0-9]', '', 'g') end when 'siret' then case when length(regexp_replace(v, '[^0-9]', '', 'g')) = 14 then regexp_replace(v, '[^0-9]', '', 'g') end
    when 'postal_code' then case when length(regexp_replace(v, '[^0-9]', '', 'g')) = 5 then regexp_replace(v, '[^0-9]', '', 'g') end
    when 'transaction_date' then nullif(regexp_extract(v, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) || regexp_replace(regexp_extract(v, '^([0-9]{{2}}[/-][0-9]{{2}}[/-][0-9]{{4}})$', 1), '^(..).(..).(....)$', '\3-\2-\1'), '')
    when 'city' then nullif({base('v')}, '') when 'company_name_core' then nullif({tidy(f"regexp_replace(regexp_replace({base('v')}, '{N.LEGAL_FORM_PATTERN}', ' ', 'g'), '{N.NOISE_PATTERN}', ' ', 'g')")}, '') else v end"""
ONE = "(select row_id, any_value(parse_status) as st, coalesce(any_value(row_text), '') as t, any_value(fields) as fields from extraction where row_id is not null group by row_id)"
EACH = f"""with o as {ONE}, e as ({' union all '.join(f"select row_id, st, t, '{f}' as f, {VALUE.format(f)} as v, fields['{f}'].evidence_text as ev, least(1, greatest(0, coalesce(fields['{f}'].confidence, 0))) as c from o" for f in X.FIELDS)}),
b as (select *, coalesce(v, '') <> '' as filled, coalesce(ev, '') <> '' and contains(t, ev) as backed from e), n as (select *, case when filled and backed then {TESTED} end as value from b),
g as (select *, case when filled and not backed then f || ':evidence_not_in_row' when filled and value is null and f <> 'city' then case f when 'company_name_core' then f || ':empty_after_normalization' else f || ':invalid_format' end end as flag from n)"""
STATUS = "case when count(value) = 0 then 'empty' when count(flag) > 0 then 'low_confidence' when any_value(st) in ('parsed', 'low_confidence') then any_value(st) else 'parsed' end"


def verified(spark, sf_dir):
    return X.verified(table(spark, sf_dir, "extraction"))


query("extraction_fields", EACH + " select row_id, f as field, value, case when value is null then 0 else c end as confidence from g")(
    lambda s, d: verified(s, d).select("row_id", F.explode("fields").alias("field", "x")).select("row_id", "field", "x.value", "x.confidence"))
query("extraction_verified", EACH + f" select row_id, {STATUS} as parse_status, count(flag)::int as invalid_field_count, coalesce(string_agg(flag, '|' order by flag), '') as flags from g group by row_id")(
    lambda s, d: verified(s, d).select("row_id", "parse_status", "invalid_field_count", F.array_join(F.array_sort("flags"), "|").alias("flags")))
HAS = {n: f"count(value) filter (f = '{n}') > 0" for n in X.FIELDS}
NAMED = f"({HAS['company_name_core']} or {HAS['company_name_raw']})"
query(
    "extraction_readiness",
    EACH + f""", r as (select row_id, {STATUS} as st, round(sum(case when value is not null and f not in ('legal_form', 'address_fragment') then c else 0 end) / 7, 6) as extract_confidence,
    case when {HAS['siret']} then 0.98 when {HAS['siren']} then 0.9 when {NAMED} and ({HAS['city']} or {HAS['postal_code']}) then 0.75 when {NAMED} then 0.58 else 0.2 end as r,
    case when {HAS['siret']} or {HAS['siren']} then 'DIRECT_LOOKUP' when {NAMED} then 'SEARCH' when {STATUS} = 'empty' then 'NEEDS_MORE_DATA' else 'MANUAL_REVIEW' end as next_action from g group by row_id)
    select row_id, extract_confidence, round(case st when 'low_confidence' then r * 0.85 when 'empty' then least(r, 0.35) else r end, 6)::double as readiness, next_action from r""",
)(lambda s, d: X.readiness(verified(s, d)).select("row_id", F.round("extract_confidence", 6).alias("extract_confidence"), F.round("readiness", 6).alias("readiness"), "next_action"))


@query("eod_decisions")
def eod_decisions(spark, sf_dir):
    """ERP rows whose best candidates are close, decided by the rows around them; resolved are those with a clear best one.

    No SQL: components need iteration. Held against a plain program in the tests.
    """
    from ledgerlink.plans.decisions import met, scores_of_all, sides

    e, r = sides(spark, sf_dir)
    top = cut(D.first(scores_of_all(e, r, "hard_veto"), E.POOL))
    best = top.where("rank = 1").select("row_id", "candidate_id", C("score").alias("best"), C("margin").alias("ahead"), "hard_veto")
    clear = best.where("best >= 0.88 and ahead >= 0.08 and not hard_veto").select("row_id", "candidate_id")
    close = best.where("best >= 0.42 and ahead < 0.08").select("row_id")
    rows = e.select("row_id", "name", "city", "postal", F.concat_ws(" ", "number", "street").alias("address"), (C("day") != "").alias("has_date"))
    side = r.select(C("c_siret").alias("candidate_id"), C("c_siren").alias("siren"), F.get("c_names", 0).alias("c_name"), "c_city", "c_postal", F.concat_ws(" ", "c_number", "c_street").alias("c_address"), (C("c_status") == "A").alias("active"), C("c_head").alias("head"))
    pool = top.join(close, "row_id").select("row_id", "candidate_id", C("rank").alias("pos"), "score", "hard_veto").join(side, "candidate_id")
    resolved = rows.join(clear, "row_id").join(side.select("candidate_id", "siren"), "candidate_id")
    # rows that meet the registry by the same keys have the same candidates: one of them stands for all
    keyed = e.join(close, "row_id").select("row_id", "siren", F.when(C("h").isNotNull(), C("postal")).alias("postal"), "h")
    alike = keyed.groupBy("siren", "postal", "h").agg(F.min("row_id").alias("row_id"))
    same = keyed.withColumn("like", F.min("row_id").over(Window.partitionBy("siren", "postal", "h"))).select("row_id", "like")
    sirens = met(alike, r.select("c_siret", "c_siren", "c_postal", "h")).select("row_id", C("c_siren").alias("siren"))
    out = E.reranked(rows.join(close, "row_id"), pool, resolved, sirens=sirens, same=same)
    return out.where("chosen").select("row_id", "candidate_id", "eod_score", "margin", "decision", "reason")
