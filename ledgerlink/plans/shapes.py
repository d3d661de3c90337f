"""Flat forms of nested records, rows for grids and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions import shapes as H
from ledgerlink.operators import registry as R
from ledgerlink.plans.lookups import CURRENT, LATEST, latest
from ledgerlink.plans.registry import query
from ledgerlink.session import table

C = F.col
BODY = "b as (select page_id, body::json as j from registry_page where json_valid(body) and json_type(body) = 'OBJECT'), t as (select page_id, x.* from b, json_tree(b.j) x)"
TEXT = "case when type = 'NULL' then '' when type = 'VARCHAR' then atom->>'$' else atom::varchar end"
#: A path of json_tree with underscores, the quotes of unusual keys left out.
UNDER = "replace(replace(replace(replace(substr(fullkey, 3), '\"', ''), '[', '_'), ']', ''), '.', '_')"
DOTS = "replace(substr(fullkey, 3), '\"', '')"


def _flat(rule: str):
    def run(spark, sf_dir):
        pages = table(spark, sf_dir, "registry_page").select("page_id", F.explode(H.flat(C("body"), rule)).alias("x"))
        return pages.select("page_id", "x.key", "x.value")

    return run


query("flatten_every_list", f"with {BODY} select page_id, {UNDER} as key, {TEXT} as value from t where type not in ('OBJECT', 'ARRAY')")(_flat("leaves"))
MIXED = "(select page_id, fullkey, type, value, value::varchar as v from t where type = 'ARRAY' and list_bool_or(list_transform(json_extract(value, '$[*]'), lambda y: json_type(y) <> 'OBJECT')))"
query(
    "flatten_records",
    f"""with {BODY}, mixed as {MIXED} select page_id, {UNDER} as key, {TEXT} as value from t
    where type not in ('OBJECT', 'ARRAY') and not exists (select 1 from mixed m where m.page_id = t.page_id and starts_with(t.fullkey, m.fullkey || '['))
    union all select page_id, {UNDER}, '' from t where fullkey <> '$' and ((type = 'OBJECT' and len(json_keys(value)) = 0) or (type = 'ARRAY' and json_array_length(value) = 0))
        and not exists (select 1 from mixed m where m.page_id = t.page_id and starts_with(t.fullkey, m.fullkey || '['))""",
)(lambda s, d: _without_mixed_lists(s, d))
query("flatten_columns", f"with {BODY} select {DOTS} as path, count(distinct page_id) as pages from t where type <> 'OBJECT' and not contains(fullkey, '[') and not contains(fullkey, '_raw') group by 1")(lambda s, d: _flat("columns")(s, d).groupBy(C("key").alias("path")).agg(F.count_distinct("page_id").alias("pages")))
query(
    "flatten_details",
    f"""with {BODY} select page_id, {DOTS} as key, case when type in ('NULL', 'ARRAY') then '-' when type = 'BOOLEAN' then case when atom::varchar = 'true' then 'Oui' else 'Non' end when {TEXT} = '' then '-' else {TEXT} end as value from t
    where (type not in ('OBJECT', 'ARRAY') or type = 'ARRAY' and json_array_length(value) = 0) and not contains(fullkey, '_raw')""",
)(_flat("details"))


def _without_mixed_lists(spark, sf_dir):
    """All but the lists that stay JSON, whose blanks differ between writers of JSON."""
    return _flat("records")(spark, sf_dir).where(~F.startswith("value", F.lit("[")))


def _first_period(field: str):
    return F.get("periodesEtablissement", 0)[field]


def _or(*columns, last: str = ""):
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(last))


def _unit(field: str):
    return C("uniteLegale")[field]


def _place(field: str):
    return C("adresseEtablissement")[field]


@query(
    "api_rows",
    f"""with {LATEST} select coalesce(siret, '') as API_SIRET, coalesce(siren, '') as API_SIREN,
    coalesce(nullif(periodesEtablissement[1].denominationUsuelleEtablissement, ''), nullif(periodesEtablissement[1].enseigne1Etablissement, ''), nullif(uniteLegale.denominationUniteLegale, ''), 'N/A') as API_Nom,
    coalesce(uniteLegale.denominationUniteLegale, '') as API_Raison_Sociale, coalesce(periodesEtablissement[1].etatAdministratifEtablissement, '') as API_Etat,
    coalesce(adresseEtablissement.numeroVoieEtablissement, '') as API_Adresse_Numero, coalesce(adresseEtablissement.libelleVoieEtablissement, '') as API_Adresse_Voie,
    coalesce(adresseEtablissement.codePostalEtablissement, '') as API_Code_Postal, coalesce(adresseEtablissement.libelleCommuneEtablissement, '') as API_Commune,
    coalesce(periodesEtablissement[1].activitePrincipaleEtablissement, '') as API_Activite, case when etablissementSiege then 'Oui' else 'Non' end as API_Siege from l""",
)
def api_rows(spark, sf_dir):
    """Establishments as rows for an export; unlike searches, these read the first period, not the current one."""
    p = _first_period
    return latest(spark, sf_dir).select(
        _or(C("siret")).alias("API_SIRET"), _or(C("siren")).alias("API_SIREN"),
        _or(p("denominationUsuelleEtablissement"), p("enseigne1Etablissement"), _unit("denominationUniteLegale"), last="N/A").alias("API_Nom"),
        _or(_unit("denominationUniteLegale")).alias("API_Raison_Sociale"), _or(p("etatAdministratifEtablissement")).alias("API_Etat"),
        _or(_place("numeroVoieEtablissement")).alias("API_Adresse_Numero"), _or(_place("libelleVoieEtablissement")).alias("API_Adresse_Voie"),
        _or(_place("codePostalEtablissement")).alias("API_Code_Postal"), _or(_place("libelleCommuneEtablissement")).alias("API_Commune"),
        _or(p("activitePrincipaleEtablissement")).alias("API_Activite"), F.when(C("etablissementSiege"), "Oui").otherwise("Non").alias("API_Siege"),
    )


@query(
    "legal_unit_rows",
    f"""with {LATEST}, u as (select siren, max_by(uniteLegale, (dateDernierTraitementEtablissement, siret)) as u from l where siren is not null and uniteLegale is not null group by siren)
    select siren, coalesce(nullif(u.denominationUniteLegale, ''), case when u.prenom1UniteLegale <> '' and u.nomUniteLegale <> '' then u.prenom1UniteLegale || ' ' || u.nomUniteLegale else nullif(u.nomUniteLegale, '') end, 'N/A') as name,
    u.denominationUniteLegale as legal_name, u.etatAdministratifUniteLegale as status, u.categorieJuridiqueUniteLegale as category from u""",
)
def legal_unit_rows(spark, sf_dir):
    """One row for each legal unit, as its establishments last described it; individuals go by first name and name."""
    u = latest(spark, sf_dir).where("siren is not null and uniteLegale is not null").groupBy("siren").agg(F.max_by("uniteLegale", F.struct("dateDernierTraitementEtablissement", "siret")).alias("u"))
    n = lambda f: F.nullif(C(f"u.{f}"), F.lit(""))
    person = F.when(n("prenom1UniteLegale").isNotNull() & n("nomUniteLegale").isNotNull(), F.concat_ws(" ", "u.prenom1UniteLegale", "u.nomUniteLegale")).otherwise(n("nomUniteLegale"))
    return u.select("siren", F.coalesce(n("denominationUniteLegale"), person, F.lit("N/A")).alias("name"), C("u.denominationUniteLegale").alias("legal_name"), C("u.etatAdministratifUniteLegale").alias("status"), C("u.categorieJuridiqueUniteLegale").alias("category"))


SHOW = "case when coalesce({0}, '') = '' then '-' else {0} end"


@query(
    "display_rows",
    f"""with {LATEST}, c as (select *, {CURRENT} as p from l), s as (select siret, coalesce(nullif(trim(p.etatAdministratifEtablissement), ''), nullif(trim(etatAdministratifEtablissement), '')) as st, etablissementSiege as h, trancheEffectifsEtablissement as w from c)
    select siret, case when st = 'A' then 'Actif' when st in ('F', 'C') then 'Fermé' else {SHOW.format('st')} end as status, case when h is null then '-' when h then 'Oui' else 'Non' end as head, {SHOW.format('w')} as workforce from s""",
)
def display_rows(spark, sf_dir):
    e = latest(spark, sf_dir)
    status = R.search_row(e).select("siret", "status")
    return e.select("siret", C("etablissementSiege").alias("h"), C("trancheEffectifsEtablissement").alias("w")).join(status, "siret").select("siret", H.display_status(C("status")).alias("status"), H.display_flag(C("h")).alias("head"), H.display(C("w")).alias("workforce"))


@query(
    "kpi_columns",
    f"""with {LATEST} select siret as KPI_SIRET, siren as KPI_SIREN, coalesce(nullif(periodesEtablissement[1].denominationUsuelleEtablissement, ''), nullif(periodesEtablissement[1].enseigne1Etablissement, ''), nullif(uniteLegale.denominationUniteLegale, ''), '') as KPI_COMPANY_NAME,
    coalesce(periodesEtablissement[1].etatAdministratifEtablissement, '') as KPI_ADMIN_STATUS, case when etablissementSiege then 'YES' else 'NO' end as KPI_IS_HEADQUARTERS, coalesce(dateCreationEtablissement, '') as KPI_CREATION_DATE, coalesce(periodesEtablissement[1].activitePrincipaleEtablissement, '') as KPI_NAF,
    coalesce(adresseEtablissement.codePostalEtablissement, '') as KPI_POSTAL_CODE, coalesce(adresseEtablissement.libelleCommuneEtablissement, '') as KPI_CITY, count(*) over (partition by siren) as KPI_ESTABLISHMENT_COUNT from l""",
)
def kpi_columns(spark, sf_dir):
    """Indicators by path, by rule and by aggregate; an absent path gives ''. Counts by SIREN are made before they are joined, so that a hot SIREN is no hot task."""
    p = _first_period
    e = latest(spark, sf_dir)
    counts = e.groupBy(C("siren").alias("_siren")).agg(F.count("*").alias("KPI_ESTABLISHMENT_COUNT"))
    return e.join(counts, C("siren").eqNullSafe(C("_siren"))).select(
        C("siret").alias("KPI_SIRET"), C("siren").alias("KPI_SIREN"), _or(p("denominationUsuelleEtablissement"), p("enseigne1Etablissement"), _unit("denominationUniteLegale")).alias("KPI_COMPANY_NAME"), _or(p("etatAdministratifEtablissement")).alias("KPI_ADMIN_STATUS"),
        F.when(C("etablissementSiege"), "YES").otherwise("NO").alias("KPI_IS_HEADQUARTERS"), _or(C("dateCreationEtablissement")).alias("KPI_CREATION_DATE"), _or(p("activitePrincipaleEtablissement")).alias("KPI_NAF"),
        _or(_place("codePostalEtablissement")).alias("KPI_POSTAL_CODE"), _or(_place("libelleCommuneEtablissement")).alias("KPI_CITY"), "KPI_ESTABLISHMENT_COUNT",
    )


@query("raw_text", "select row_id, left(array_to_string(list_filter(list_transform([Original_SIRET, Original_SIREN, Original_Name, Original_City, Original_CP, Original_Address], lambda x: trim(coalesce(x, ''))), lambda x: x <> ''), ' | '), 4000) as text from erp_row")
def raw_text(spark, sf_dir):
    """A row as one line of text, blanks left out, at most 4000 characters: a column of reports, whose width is part of its format."""
    cells = F.transform(F.array("Original_SIRET", "Original_SIREN", "Original_Name", "Original_City", "Original_CP", "Original_Address"), lambda x: F.trim(F.coalesce(x, F.lit(""))))
    return table(spark, sf_dir, "erp_row").select("row_id", F.substring(F.array_join(F.filter(cells, lambda x: x != ""), " | "), 1, 4000).alias("text"))


@query("stable_json", """select row_id, '{"a":' || to_json(coalesce(Original_CP, '')) || ',"b":' || to_json(coalesce(Original_City, '')) || '}' as json from erp_row""")
def stable_json(spark, sf_dir):
    cells = F.create_map(F.lit("b"), F.coalesce("Original_City", F.lit("")), F.lit("a"), F.coalesce("Original_CP", F.lit("")))
    return table(spark, sf_dir, "erp_row").select("row_id", H.stable_json(cells).alias("json"))


@query(
    "field_audit",
    """with f as (select row_id, unnest(map_entries(fields)) as e, trim(coalesce(row_text, '')) as t from (select distinct on (row_id) * from extraction order by row_id, row_text))
    select row_id, e.key as field, coalesce(e.value.value, '') as original, upper(trim(coalesce(e.value.value, ''))) as normalized, case when contains(t, coalesce(e.value.evidence_text, '')) then coalesce(e.value.value, '') else '' end as corrected,
    case when e.value.confidence is null then null else round(e.value.confidence, 4) end as confidence from f""",
)
def field_audit(spark, sf_dir):
    """What each field was, its normal form and what is left of it after the check against the text, one row for each field."""
    one = table(spark, sf_dir, "extraction").groupBy("row_id").agg(F.min_by(F.struct("fields", "row_text"), "row_text").alias("x"))
    e = one.select("row_id", F.explode("x.fields").alias("field", "v"), F.trim(F.coalesce("x.row_text", F.lit(""))).alias("t"))
    value = F.coalesce("v.value", F.lit(""))
    return e.select("row_id", "field", value.alias("original"), F.upper(F.trim(value)).alias("normalized"), F.when(F.contains("t", F.coalesce("v.evidence_text", F.lit(""))), value).otherwise("").alias("corrected"), F.round("v.confidence", 4).alias("confidence"))
