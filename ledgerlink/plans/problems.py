"""Queries over the project's tables for the general problems, with SQL of the same meaning for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlink.operators.asof import erp_attributes
from ledgerlink.operators.nested import CHILDREN, flat_table, linked_rows
from ledgerlink.operators.rejects import split_uploads
from ledgerlink.session import table


def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ERP row with a usable date and SIRET, with what was known of its establishment on that day."""
    return erp_attributes(table(spark, sf_dir, "erp_row"), table(spark, sf_dir, "etablissement"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_attributes(spark, sf_dir).where("date_debut is not null").select("row_id", "delivery_id", "date_debut")


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record as it came, with its state, reason of fault, typed values and all its columns by name."""
    return split_uploads(table(spark, sf_dir, "upload_raw")).select("line_id", "file_id", "line_no", "raw", "state", "reason", "siret", "day", "amount", "fields")


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of every loaded record."""
    return split_uploads(table(spark, sf_dir, "upload_raw")).where("state = 'loaded'").select("line_id", F.explode("fields").alias("name", "value"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_uploads(table(spark, sf_dir, "upload_raw"), with_fields=False).where("state = 'rejected' and reason <> 'no_header'").select("line_id", "reason")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linked_rows(table(spark, sf_dir, "registry_page"), CHILDREN, with_json=False)
    return rows.select("page_id", "etab_idx", "siret", "child", "child_idx")


def p4_table(child: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat_table(linked_rows(table(spark, sf_dir, "registry_page"), [child]), child)

    return query


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_attributes": p1_attributes, "p2_found": p2_found, "p2_rows": p2_rows, "p2_values": p2_values, "p4_found": p4_found,
        "p4_establishments": p4_table("etablissement"), "p4_legal_units": p4_table("uniteLegale"), "p4_addresses": p4_table("adresseEtablissement"), "p4_second_addresses": p4_table("adresse2Etablissement"), "p4_periods": p4_table("periodesEtablissement"),
    }


P1 = r"""
with e0 as (
    select row_id, regexp_replace(Original_SIRET, '[^0-9]', '', 'g') as siret, regexp_replace(Transaction_Date, '^[\s\x{00A0}\x{202F}]+|[\s\x{00A0}\x{202F}]+$', '', 'g') as t from erp_row),
e1 as (
    select row_id, siret, case when regexp_full_match(t, '[0-9]{4}-[0-9]{2}-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?') then t[1:10]
        when regexp_full_match(t, '[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}') then t[7:10] || '-' || t[4:5] || '-' || t[1:2] end as d from e0 where row_id is not null and length(siret) = 14),
e as (select row_id, min((siret, try_cast(d as date))) as x from e1 where d not like '0000%' and try_cast(d as date) is not null group by row_id),
v as (select distinct siret, delivery_id, dateDernierTraitementEtablissement as known, periodesEtablissement as periods from etablissement),
m as (
    select e.row_id, e.x[1] as siret, e.x[2] as day, v.delivery_id, v.periods from e left join v on v.siret = e.x[1] and cast(v.known as date) <= e.x[2]
    qualify row_number() over (partition by e.row_id order by v.known desc nulls last, v.delivery_id desc) = 1),
p as (
    select *, list_max(list_filter(periods, lambda p: p.dateDebut <> '' and p.dateDebut <= strftime(day, '%Y-%m-%d') and coalesce(nullif(p.dateFin, ''), '9999-12-31') >= strftime(day, '%Y-%m-%d'))) as p from m)
"""
FIELD = r'''(?:"(?:[^"]|"")*"|[^"{d}]*)'''
P2_BRANCHES = " ".join(
    f"when '{d}' then case when regexp_full_match(raw, '{FIELD.format(d=d)}(?:[{d}]{FIELD.format(d=d)})*') then list_transform(regexp_extract_all('{d}' || raw, '[{d}]({FIELD.format(d=d)})', 1), lambda f: case when f like '\"%' then replace(f[2:-2], '\"\"', '\"') else f end) end"
    for d in (",", ";", "|", "\t")
)
P2 = rf"""
with h0 as (select file_id, replace(replace(min(case when line_no = 1 then (line_id, raw) end)[2], '"', ''), chr(65279), '') as head from upload_raw group by file_id),
h1 as (select *, case when head like '%,%' then ',' when head like '%;%' then ';' when head like '%|%' then '|' else chr(9) end as d from h0),
h as (select file_id, d, string_split(head, d) as names from h1),
r as (select line_id, u.file_id, line_no, raw, names, case d {P2_BRANCHES} end as f from upload_raw u join h using (file_id)
    where line_no <> 1 and regexp_replace(raw, '[\s\x{{00A0}}\x{{202F}}]', '', 'g') <> ''),
w as (select *, f is null as broken, len(f) <> len(names) as odd, regexp_replace(f[list_position(names, 'FR_SIRET')], '[ \t\x{{00A0}}\x{{202F}}.\-]', '', 'g') as s,
    regexp_replace(f[list_position(names, 'Transaction_Date')], '^[\s\x{{00A0}}\x{{202F}}]+|[\s\x{{00A0}}\x{{202F}}]+$', '', 'g') as t,
    regexp_replace(f[list_position(names, 'Amount')], '^[\s\x{{00A0}}\x{{202F}}]+|[\s\x{{00A0}}\x{{202F}}]+$', '', 'g') as a from r),
x as (select *, case when regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then t when regexp_full_match(t, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') then t[7:10] || '-' || t[4:5] || '-' || t[1:2] end as iso from w),
y as (select *, case when broken then 'broken_quoting' when odd then 'column_count' when s <> '' and not regexp_full_match(s, '[0-9]{{14}}') then 'invalid_siret'
    when t <> '' and (iso is null or iso like '0000%' or try_cast(iso as date) is null) then 'invalid_date'
    when a <> '' and not regexp_full_match(a, '-?[0-9]+([.,][0-9]+)?') then 'invalid_amount' end as reason from x)
"""
P4 = """
with b as (select page_id, cast(body as json) as j from registry_page where json_valid(body) and json_type(body) = 'OBJECT'),
l as (
    select page_id, j->'$.etablissements' as es, j->'$.etablissement' as e1 from b),
s as (
    select page_id, unnest(range(cast(json_array_length(es) as bigint))) as i, es, e1 from l where json_type(es) = 'ARRAY'
    union all select page_id, 0, es, e1 from l where json_type(es) is distinct from 'ARRAY'),
e as (
    select page_id, cast(i as int) as etab_idx, case when json_type(es) = 'ARRAY' then json_extract(es, '$[' || i || ']') when es is not null then es else e1 end as e from s),
k as (select * from e where json_type(e) = 'OBJECT')
"""
CHILD = """
select page_id, etab_idx, e->>'$.siret' as siret, '{c}' as child, cast(i as int) as child_idx, c from (
    select page_id, etab_idx, e, unnest(range(cast(json_array_length(e->'$.{c}') as bigint))) as i, json_extract(e, '$.{c}[' || i || ']') as c from k where json_type(e->'$.{c}') = 'ARRAY'
    union all select page_id, etab_idx, e, 0, e->'$.{c}' from k where json_type(e->'$.{c}') = 'OBJECT')
where json_type(c) = 'OBJECT'
"""


def _fields(child: str, source: str) -> str:
    from ledgerlink.operators.nested import TABLES

    return ", ".join(f"{source}->>'$.{f.split()[0]}' as {f.split()[0]}" for f in TABLES[child].split(", "))


def oracle_sql() -> dict[str, str]:
    from ledgerlink.operators.nested import CHILDREN

    every = " union all ".join(CHILD.format(c=c) for c in CHILDREN)
    one = {c: f"{P4} select page_id, etab_idx, siret, child_idx, {_fields(c, 'c')} from ({CHILD.format(c=c)})" for c in CHILDREN}
    return {
        "p1_found": P1 + "select row_id, delivery_id, p.dateDebut as date_debut from p where p is not null",
        "p1_attributes": P1 + "select row_id, siret, day, delivery_id, p.dateDebut as date_debut, p.etatAdministratifEtablissement as status, p.enseigne1Etablissement as sign, p.activitePrincipaleEtablissement as activity from p",
        "p2_found": P2 + "select line_id, reason from y where reason is not null",
        "p2_values": P2 + "select line_id, unnest(names) as name, unnest(f) as value from y where reason is null",
        "p4_found": f"{P4} select page_id, etab_idx, siret, child, child_idx from ({every})",
        "p4_establishments": f"{P4} select page_id, etab_idx, e->>'$.siret' as siret, {_fields('etablissement', 'e')} from k",
        "p4_legal_units": one["uniteLegale"], "p4_addresses": one["adresseEtablissement"], "p4_second_addresses": one["adresse2Etablissement"], "p4_periods": one["periodesEtablissement"],
    }
