"""Typed identifiers, VAT answers, search phrases, and resolution by several strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N
from ledgerlink.functions import planning as P
from ledgerlink.functions import vat as V
from ledgerlink.operators import registry as R
from ledgerlink.operators import resolve as Z
from ledgerlink.plans.lookups import CURRENT, LATEST, fold, latest, prefixes
from ledgerlink.plans.registry import query
from ledgerlink.plans.scalars import alnum, base, core, digits, expanded, hinted, listed, stripped, words
from ledgerlink.session import table

C = F.col
ADDRESS, NAME, CP = "Original_Address", "Original_Name", "Original_CP"
CELLS = ["Original_SIRET", "Original_SIREN", NAME, "Original_City", CP]
TOP = "regexp_replace(upper(coalesce({0}, '')), '[\\s\\x{{00A0}}\\x{{202F}}]', '', 'g')"


def over_rows(name: str, columns: dict, sql: dict[str, str]):
    """A query that adds columns to erp_row."""
    query(name, "select row_id, " + ", ".join(f"{x} as {k}" for k, x in sql.items()) + " from erp_row")(lambda s, d: table(s, d, "erp_row").select("row_id", *[f().alias(k) for k, f in columns.items()]))


over_rows("search_escape", {"escaped": lambda: P.escape_search(C(NAME))}, {"escaped": rf"""regexp_replace(regexp_replace(strip_accents(replace(replace(replace(replace(regexp_replace(coalesce({NAME}, ''), '[''.\-_&+,;:!]', ' ', 'g'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE')), '[\x{{0300}}-\x{{036F}}]', '', 'g'), '([+&|!(){{}}\[\]^"~?:\\/])', '\\\1', 'g')"""})
over_rows("vat_mask", {"masked": lambda: V.masked(C("Original_SIRET"))}, {"masked": f"substr(regexp_replace({TOP.format('Original_SIRET')}, '[^A-Z0-9+*]', '', 'g'), 1, 16)"})
over_rows(
    "typed_identifiers",
    {"kind": lambda: V.identifier_kind(C("Original_SIRET"))[0], "formatted": lambda: V.identifier_kind(C("Original_SIRET"))[1], "name_ok": lambda: V.acceptable_name(C(NAME)), "postal_ok": lambda: V.acceptable_postal(C(CP))},
    {
        "kind": r"case when regexp_full_match(regexp_replace(coalesce(Original_SIRET, ''), '[\s-]', '', 'g'), '[0-9]{14}') then 'siret' when regexp_full_match(regexp_replace(coalesce(Original_SIRET, ''), '[\s-]', '', 'g'), '[0-9]{9}') then 'siren' end",
        "formatted": r"case when regexp_full_match(regexp_replace(coalesce(Original_SIRET, ''), '[\s-]', '', 'g'), '[0-9]{14}|[0-9]{9}') then regexp_replace(coalesce(Original_SIRET, ''), '[\s-]', '', 'g') end",
        "name_ok": f"length(trim(coalesce({NAME}, ''))) >= 3",
        "postal_ok": f"coalesce({CP}, '') = '' or regexp_full_match({CP}, '[0-9]{{5}}')",
    },
)
IDS = "regexp_extract_all(array_to_string(list_filter([" + ", ".join(f"coalesce({c}, '')" for c in CELLS) + "], lambda x: not regexp_matches(x, '[eE]')), ' '), '[0-9]{9,14}')"
over_rows("row_identifiers", {"siret": lambda: P.exact_ids(F.array(*CELLS))[0], "siren": lambda: P.exact_ids(F.array(*CELLS))[1]}, {"siret": f"list_filter({IDS}, lambda x: length(x) = 14)[1]", "siren": f"coalesce(list_filter({IDS}, lambda x: length(x) = 9)[1], list_filter({IDS}, lambda x: length(x) = 14)[1][1:9])"})
TOKEN = f"regexp_replace({base('w')}, '[^A-Za-z0-9_]', '', 'g')"
KIND = f"""case when {TOKEN} = '' or {TOKEN} in ({listed(N.STOPWORDS)}) or regexp_matches({TOKEN}, '\\b(FACTURE|INVOICE|REF|REFERENCE|BON|BC|BL)\\b', 'i') or regexp_matches({TOKEN}, '\\b0[1-9][0-9]{{8}}\\b') or regexp_full_match({TOKEN}, '[A-Z]*[0-9]{{5,}}') then 'noise'
    when regexp_full_match({TOKEN}, '[0-9]{{9}}|[0-9]{{14}}') then 'identity' when {TOKEN} in ({listed(N.LEGAL_FORMS)}) then 'supporting' when length({TOKEN}) <= 2 then 'noise' else 'supporting' end"""
query(
    "word_kinds",
    f"with w as (select row_id, unnest(list_distinct(flatten(list_transform([{', '.join(CELLS)}], lambda x: regexp_split_to_array(coalesce(x, ''), '[\\s,;|/\\\\-]+'))))) as w from (select distinct row_id, {', '.join(CELLS)} from erp_row)) select row_id, {KIND} as kind, count(*) as n from w where w <> '' group by all",
)(lambda s, d: _word_kinds(s, d))


def _word_kinds(spark, sf_dir):
    """How many different words of each kind a row has."""
    rows = table(spark, sf_dir, "erp_row").select("row_id", *CELLS).distinct()
    counts = F.array(*[F.struct(F.lit(k).alias("kind"), F.size(P.row_words(F.array(*CELLS), k)).cast("bigint").alias("n")) for k in ("identity", "supporting", "noise")])
    each = rows.select("row_id", F.explode(counts).alias("x")).where("x.n > 0")
    return each.groupBy("row_id", "x.kind").agg(F.sum("x.n").alias("n"))


EXPANDED = expanded(f"({hinted(f"coalesce(nullif({stripped(NAME)}, ''), {NAME}, '')")})")
over_rows("name_acronym", {"acronym": lambda: P.acronym(C(NAME))}, {"acronym": f"(select case when length(a) >= 2 then a else '' end from (select array_to_string(list_transform(list_filter({words('x')}, lambda w: length(w) >= 2), lambda w: w[1:1]), '') as a from (select {EXPANDED} as x)))"})
over_rows("canonical_postal", {"postal": lambda: P.canonical_postal(C(CP)), "department": lambda: P.canonical_department(C(CP))}, {"postal": f"case when length({digits(CP)}) > 5 then {digits(CP)} else lpad({digits(CP)}, 5, '0') end", "department": f"case when regexp_matches(case when length({digits(CP)}) > 5 then {digits(CP)} else lpad({digits(CP)}, 5, '0') end, '^9[78]') then (case when length({digits(CP)}) > 5 then {digits(CP)} else lpad({digits(CP)}, 5, '0') end)[1:3] else (case when length({digits(CP)}) > 5 then {digits(CP)} else lpad({digits(CP)}, 5, '0') end)[1:2] end"})
ESCAPED = "replace(replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
over_rows("cell_escapes", {"xml": lambda: P.xml_escape(C(NAME)), "csv": lambda: P.csv_cell(C(NAME))}, {"xml": f"replace({ESCAPED.format(NAME)}, '''', '&apos;')", "csv": f"'\"' || replace(coalesce({NAME}, ''), '\"', '\"\"') || '\"'"})
over_rows("leading_number", {"number": lambda: P.leading_number(C(ADDRESS), -1.0)}, {"number": rf"coalesce(try_cast(nullif(regexp_extract(trim(coalesce({ADDRESS}, '')), '^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)', 1), '') as double), -1.0)"})
over_rows(
    "vat_interactive",
    {"country": lambda: V.interactive_split(C("Original_SIRET"), F.substring(C("Original_City"), 1, 0))[0], "number": lambda: V.interactive_split(C("Original_SIRET"), F.substring(C("Original_City"), 1, 0))[1], "french": lambda: V.french(C(NAME))},
    {"country": f"regexp_extract({TOP.format('Original_SIRET')}, '^([A-Z]{{2}})([A-Z0-9+*]+)$', 1)", "number": f"case when regexp_full_match({TOP.format('Original_SIRET')}, '([A-Z]{{2}})([A-Z0-9+*]+)') then {TOP.format('Original_SIRET')}[3:] else {TOP.format('Original_SIRET')} end", "french": f"upper(regexp_extract(coalesce({NAME}, ''), '(?i)\\b(FR[0-9A-Z]{{2}}[0-9]{{9}})\\b', 1))"},
)

# Answers of a VAT register, made from suppliers: the same text in both languages.
PAYLOAD = """concat('{', case s_suppkey % 6 when 0 then '"isValid":true' when 1 then '"isValid":"false"' when 2 then '"isValid":null,"valid":true' when 3 then '"valid":"yes"' when 4 then '"is_valid":1' else '"isValid":false,"userError":"MS_UNAVAILABLE"' end,
    case s_suppkey % 4 when 0 then concat(',"name":"', s_name, '"') when 1 then concat(',"name":" ","traderName":"', s_name, '"') when 2 then concat(',"trader":{"name":"', s_name, '"}') else '' end, case when s_suppkey % 3 = 0 then ',"company_address":"1 RUE","requestDate":"2024-01-02"' else '' end, '}')"""


def _answers(nested: bool):
    def run(spark, sf_dir):
        a = table(spark, sf_dir, "supplier").select("s_suppkey", F.try_parse_json(F.expr(PAYLOAD)).alias("p"), F.lit("FR").alias("c"), C("s_suppkey").cast("string").alias("n"))
        return a.select("s_suppkey", *[c.alias(k) for k, c in V.register_answer(C("p"), C("c"), C("n"), nested).items()])

    return run


def _answer_sql(nested: bool) -> str:
    first = lambda names, last="''": "coalesce(" + ", ".join([*(f"nullif(trim(j->>'$.{n}'), '')" for n in names), last]) + ")"
    inner = lambda leaf: ["trader." + leaf, "legal." + leaf, "company." + leaf] if nested else []
    return f"""with a as (select s_suppkey, ({PAYLOAD})::json as j from supplier), v as (select *, case when json_exists(j, '$.isValid') then j->'$.isValid' when json_exists(j, '$.valid') then j->'$.valid' else j->'$.is_valid' end as v from a)
    select s_suppkey, case when coalesce(j->>'$.userError', '') <> '' then j->>'$.userError' when json_type(v) = 'VARCHAR' and v->>'$' <> '' or json_type(v) = 'BOOLEAN' and v::varchar = 'true' or json_type(v) not in ('VARCHAR', 'BOOLEAN', 'NULL') and v::varchar <> '0' then 'VALID' else 'INVALID' end as status,
    case when lower(trim(coalesce(v->>'$', ''))) in ('true', 'valid', 'yes', '1') then 'Yes' else 'No' end as is_valid, {first([*V.NAMES, *inner('name')])} as legal_name, {first([*V.ADDRESSES, *inner('address')])} as registered_address, coalesce(j->>'$.requestDate', '') as request_date,
    'FR' as country_code, s_suppkey::varchar as vat_number, 'FR' || s_suppkey as original_vat_number from v"""


query("vat_answers", _answer_sql(False))(_answers(False))
query("vat_answers_nested", _answer_sql(True))(_answers(True))


@query("siren_search", f"""with {LATEST}, u as (select distinct on (siren) siren, uniteLegale as u from l where siren is not null order by siren, siret)
    select siren from u where {prefixes('u.denominationUniteLegale', 'GARAGE')} or {prefixes('u.denominationUsuelle1UniteLegale', 'GARAGE')}""")
def siren_search(spark, sf_dir):
    """Legal units whose legal or first usual name has words that begin so."""
    u = latest(spark, sf_dir).where("siren is not null").groupBy("siren").agg(F.min_by("uniteLegale", "siret").alias("u"))
    return u.where(R.word_prefixes(C("u.denominationUniteLegale"), "GARAGE") | R.word_prefixes(C("u.denominationUsuelle1UniteLegale"), "GARAGE")).select("siren")


TWELVE = [f"uniteLegale.{f}" for f in ("denominationUniteLegale", "denominationUsuelle1UniteLegale", "denominationUsuelle2UniteLegale", "denominationUsuelle3UniteLegale")] + ["enseigne1Etablissement", "enseigne2Etablissement", "enseigne3Etablissement", "denominationUsuelleEtablissement"]
PERIOD4 = ["enseigne1Etablissement", "enseigne2Etablissement", "enseigne3Etablissement", "denominationUsuelleEtablissement"]


@query(
    "strict_search",
    f"with {LATEST}, c as (select *, {CURRENT} as p from l), n as (select siret, unnest([{', '.join([*TWELVE, *(f'p.{f}' for f in PERIOD4)])}]) as n from c) select distinct siret from n where list_contains(list_filter(regexp_split_to_array(regexp_replace({fold('n')}, '\\([^)]*\\)', ' ', 'g'), '[\\s\\-.''*/()\\[\\]]+'), lambda w: w <> ''), 'GARAGE')",
)
def strict_search(spark, sf_dir):
    """Establishments one of whose twelve names has the word itself."""
    p = R.current_period(C("periodesEtablissement"))
    names = F.array(*[C(f) for f in TWELVE], *[p[f] for f in PERIOD4])
    return latest(spark, sf_dir).where(F.exists(F.filter(names, lambda n: n.isNotNull()), lambda n: R.strict_match(n, "garage"))).select("siret")


@query("first_seen", "select company_name_raw, arg_min(entry_id, (coalesce(typed_at, '9999-12-31'::timestamp), entry_id)) as entry_id, count(*) as n from name_entry group by 1")
def first_seen(spark, sf_dir):
    """The first entry that bears each spelling."""
    at = F.coalesce(C("typed_at").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz"))
    return table(spark, sf_dir, "name_entry").groupBy("company_name_raw").agg(F.min_by("entry_id", F.struct(at, "entry_id")).alias("entry_id"), F.count("*").alias("n"))


HQ = "h as (select siren, count(*) as n, arg_min(siret, (not coalesce(etablissementSiege, false), siret)) as siret from l where siren is not null group by siren)"


@query("siren_resolve", f"with {LATEST}, {HQ} select row_id, h.siret, case when h.n is not null then least(h.n, 20) end as candidate_count, h.n > 1 as several from (select distinct row_id, {digits('Original_SIREN')} as s from erp_row) e left join h on h.siren = case when length(s) = 9 then s end")
def siren_resolve(spark, sf_dir):
    """The establishment that stands for a row's SIREN: the head office, else the least SIRET."""
    rows = table(spark, sf_dir, "erp_row").select("row_id", N.digits(C("Original_SIREN")).alias("s")).distinct()
    return Z.by_siren(rows, latest(spark, sf_dir), F.when(F.length("s") == 9, C("s"))).select("row_id", "siret", "candidate_count", "several")


@query(
    "resolve_chain",
    f"""with {LATEST}, {HQ}, e as (select distinct row_id, {digits('Original_SIRET')} as a, {digits('Original_SIREN')} as b, {core(NAME)} as n, {digits(CP)} as p from erp_row),
    k as (select {core('uniteLegale.denominationUniteLegale')} as n, adresseEtablissement.codePostalEtablissement as p, min(siret) as siret from l group by 1, 2),
    s as (select e.row_id, l.siret, 1 as way from e join l on l.siret = case when length(a) = 14 then a end union all select e.row_id, h.siret, 2 from e join h on h.siren = case when length(b) = 9 then b end
        union all select e.row_id, k.siret, 3 from e join k on k.n = e.n and k.p = e.p where e.n <> '' and e.p <> '')
    select row_id, arg_min(siret, (way, siret)) as siret, case min(way) when 1 then 'siret' when 2 then 'siren' else 'name' end as strategy from s group by row_id""",
)
def resolve_chain(spark, sf_dir):
    """Each row by the first strategy that resolves it: SIRET, SIREN, name with postal code."""
    rows = table(spark, sf_dir, "erp_row").select("row_id", N.digits(C("Original_SIRET")).alias("a"), N.digits(C("Original_SIREN")).alias("b"), N.core_name(C(NAME)).alias("n"), N.digits(C(CP)).alias("p")).distinct()
    e = latest(spark, sf_dir)
    by_siret = rows.select("row_id", F.when(F.length("a") == 14, C("a")).alias("siret")).join(e.select("siret"), "siret").select("row_id", "siret")
    by_siren = Z.by_siren(rows, e, F.when(F.length("b") == 9, C("b"))).where("siret is not null").select("row_id", "siret")
    named = e.groupBy(N.core_name(C("uniteLegale.denominationUniteLegale")).alias("n"), C("adresseEtablissement.codePostalEtablissement").alias("p")).agg(F.min("siret").alias("siret"))
    by_name = rows.where("n <> '' and p <> ''").join(named, ["n", "p"]).select("row_id", "siret")
    return Z.first_resolved({"siret": by_siret, "siren": by_siren, "name": by_name}, "row_id", "siret")


@query("grid_contains", f"""with {LATEST}, c as (select siret, siren, lower(coalesce(adresseEtablissement.libelleCommuneEtablissement, '')) as city, lower(coalesce(adresseEtablissement.codePostalEtablissement, '')) as cp, lower(coalesce(siret, '')) as s from l) select siret from c where contains(city, 'saint') and contains(cp, '7') and contains(s, '1')""")
def grid_contains(spark, sf_dir):
    """A grid's filter boxes, all of which must be contained, whatever the case."""
    return Z.contains_all(R.search_row(latest(spark, sf_dir)), {"city": "SAINT", "postal": "7", "siret": "1", "name": "", "address": "", "status": ""}).select("siret")


@query("page_info", "select p as page, 25 * (p - 1) + 1 as first, least(25 * p, n) as last, cast(ceil(n / 25) as bigint) as pages from (select count(*) as n from supplier), range(1, 4) t(p) where 25 * (p - 1) < n")
def page_info(spark, sf_dir):
    """Where the first pages begin and end."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    return Z.page_info(n.select("n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("page")), 25)


@query("name_averages", "select l_orderkey as row_id, avg(try_cast(case when l_linenumber % 3 = 0 then 'n/a' else l_discount::varchar end as double)) as confidence from lineitem group by 1")
def name_averages(spark, sf_dir):
    """The mean over what can be read as a number."""
    value = F.when(C("l_linenumber") % 3 == 0, "n/a").otherwise(C("l_discount").cast("string"))
    return table(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("row_id")).agg(F.avg(value.try_cast("double")).alias("confidence"))


@query("merge_candidates", "with u as (select o_custkey as row_id, o_orderkey as id, 1 as seq from orders where o_orderpriority like '1%' union all select o_custkey, o_orderkey, 2 from orders where o_totalprice > 100000) select row_id, id, min(seq) as source from u group by all")
def merge_candidates(spark, sf_dir):
    """Candidates of two sources, each once, as the first source has it."""
    o = table(spark, sf_dir, "orders").select(C("o_custkey").alias("row_id"), C("o_orderkey").alias("id"), "o_orderpriority", "o_totalprice")
    return Z.merged([o.where("o_orderpriority like '1%'"), o.where("o_totalprice > 100000")], ["row_id", "id"]).select("row_id", "id", "source")
