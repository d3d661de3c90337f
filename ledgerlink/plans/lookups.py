"""Enrichment, search and paging over the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N
from ledgerlink.operators import registry as R
from ledgerlink.plans.registry import query
from ledgerlink.plans.scalars import digits
from ledgerlink.session import table

C = F.col
LATEST = "l as (select * from etablissement where siret is not null qualify row_number() over (partition by siret order by dateDernierTraitementEtablissement desc, delivery_id desc) = 1)"
BEGIN = "coalesce(p.dateDebut, '')"
CURRENT = f"""coalesce(list_filter(list_filter(periodesEtablissement, lambda p: p is not null), lambda p: coalesce(p.dateFin, '') = '')[1],
    list_filter(list_filter(periodesEtablissement, lambda p: p is not null), lambda p: {BEGIN} = list_max(list_transform(list_filter(periodesEtablissement, lambda q: q is not null), lambda q: coalesce(q.dateDebut, ''))))[1])"""


def fold(x: str) -> str:
    return f"upper(regexp_replace(strip_accents(replace(replace(coalesce({x}, ''), 'œ', 'oe'), 'Œ', 'OE')), '[\\x{{0300}}-\\x{{036F}}]', '', 'g'))"


def prefixes(x: str, phrase: str) -> str:
    tests = " and ".join(f"list_bool_or(list_transform(regexp_split_to_array({fold(x)}, '[^A-Z0-9]+'), lambda t: starts_with(t, '{w}')))" for w in phrase.split())
    return f"coalesce({tests}, false)"


def latest(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "etablissement"))


ENRICH = f"""with {LATEST}, e as (select row_id, Original_SIRET, {digits('Original_SIRET')} as d from erp_row),
k as (select *, case when length(d) = 14 then d when length(d) in (12, 13) then lpad(d, 14, '0') end as key from e),
s as (select k.row_id, case when d = '' then 'SKIPPED' when l.siret is not null then 'OK' when length(d) = 14 then 'NOT_FOUND' else 'INVALID_SIRET' end as status,
    coalesce(l.siret, d) as used_siret, l.uniteLegale.denominationUniteLegale as name from k left join l on l.siret = k.key)"""


@query("siret_enrich", ENRICH + " select * from s")
def siret_enrich(spark, sf_dir):
    out = R.enriched(table(spark, sf_dir, "erp_row").select("row_id", "Original_SIRET"), latest(spark, sf_dir), C("Original_SIRET"))
    return out.select("row_id", "status", "used_siret", C("etablissement.uniteLegale.denominationUniteLegale").alias("name"))


@query("siret_status_summary", ENRICH + " select count(*) as total, count(*) filter (status = 'OK') as ok, count(*) filter (status not in ('OK', 'SKIPPED')) as not_ok, count(*) filter (status = 'SKIPPED') as skipped, count(*) filter (status = 'INVALID_SIRET') as invalid from s")
def siret_status_summary(spark, sf_dir):
    s = C("status")
    return siret_enrich(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(s == "OK").alias("ok"), F.count_if(~s.isin("OK", "SKIPPED")).alias("not_ok"), F.count_if(s == "SKIPPED").alias("skipped"), F.count_if(s == "INVALID_SIRET").alias("invalid"))


@query("siret_padded_retry", ENRICH + " select s.row_id, used_siret from s join e on s.row_id = e.row_id and s.status = 'OK' and length(e.d) in (12, 13) group by all")
def siret_padded_retry(spark, sf_dir):
    e = table(spark, sf_dir, "erp_row").select("row_id", "Original_SIRET").where(F.length(N.digits(C("Original_SIRET"))).isin(12, 13))
    return R.enriched(e, latest(spark, sf_dir), C("Original_SIRET")).where("status = 'OK'").select("row_id", "used_siret").distinct()


VAT = f"""with {LATEST}, reg as (select 'FR' as country, siren, max(uniteLegale.etatAdministratifUniteLegale) = 'A' as is_valid from l group by siren),
q as (select line_id, regexp_extract(raw, 'FR([0-9]{{11}})', 1) as number from upload_raw),
s as (select line_id, number, case when number = '' then 'MISSING_VAT' when reg.siren is null then 'NOT_FOUND' when is_valid then 'VALID' else 'INVALID' end as vat_status from q left join reg on reg.siren = q.number[3:])"""


def vat_register(spark, sf_dir):
    """A register of VAT numbers from the registry: valid while the legal unit is active. The two check digits are any."""
    r = latest(spark, sf_dir).groupBy("siren").agg((F.max("uniteLegale.etatAdministratifUniteLegale") == "A").alias("is_valid"))
    asked = table(spark, sf_dir, "upload_raw").select(F.regexp_extract("raw", r"FR(\d{11})", 1).alias("number")).where("number <> ''").distinct()
    return asked.join(r, F.substring("number", 3, 9) == C("siren")).select(F.lit("FR").alias("country"), "number", F.coalesce("is_valid", F.lit(False)).alias("is_valid"))


@query("vat_enrich", VAT + " select line_id, number, vat_status from s")
def vat_enrich(spark, sf_dir):
    q = table(spark, sf_dir, "upload_raw").select("line_id", F.lit("FR").alias("country"), F.regexp_extract("raw", r"FR(\d{11})", 1).alias("number"))
    return R.vat_enriched(q, vat_register(spark, sf_dir)).select("line_id", "number", "vat_status")


@query("vat_status", VAT + " select vat_status, count(*) as n from s group by vat_status")
def vat_status(spark, sf_dir):
    return vat_enrich(spark, sf_dir).groupBy("vat_status").agg(F.count("*").alias("n"))


@query("current_period", f"with {LATEST}, c as (select siret, {CURRENT} as p from l) select siret, p.dateDebut as date_debut, p.etatAdministratifEtablissement as status from c")
def current_period(spark, sf_dir):
    return latest(spark, sf_dir).select("siret", R.current_period(C("periodesEtablissement")).alias("p")).select("siret", C("p.dateDebut").alias("date_debut"), C("p.etatAdministratifEtablissement").alias("status"))


@query("asof_period", f"with {LATEST}, c as (select siret, list_filter(periodesEtablissement, lambda p: p.dateDebut <= '2021-06-30' and (coalesce(p.dateFin, '') = '' or p.dateFin >= '2021-06-30'))[1] as p from l) select siret, p.dateDebut as date_debut from c")
def asof_period(spark, sf_dir):
    return latest(spark, sf_dir).select("siret", R.period_at(C("periodesEtablissement"), F.lit("2021-06-30"))["dateDebut"].alias("date_debut"))


SOME = lambda x: f"nullif(trim({x}), '')"
GRID = f"""with {LATEST}, c as (select *, {CURRENT} as p from l), g as (select siret, siren,
    coalesce({SOME('uniteLegale.denominationUniteLegale')}, {SOME('p.denominationUsuelleEtablissement')}, {SOME('denominationUsuelleEtablissement')}, {SOME('p.enseigne1Etablissement')}, {SOME('enseigne1Etablissement')}, nullif(concat_ws(' ', {SOME('uniteLegale.prenom1UniteLegale')}, {SOME('uniteLegale.nomUniteLegale')}), '')) as name,
    coalesce({SOME('p.enseigne1Etablissement')}, {SOME('enseigne1Etablissement')}) as sign, coalesce({SOME('p.etatAdministratifEtablissement')}, {SOME('etatAdministratifEtablissement')}) as status, {SOME('p.activitePrincipaleEtablissement')} as activity,
    coalesce(nullif(concat_ws(' ', {', '.join(SOME(f'adresseEtablissement.{x}') for x in ('numeroVoieEtablissement', 'typeVoieEtablissement', 'libelleVoieEtablissement', 'codePostalEtablissement', 'libelleCommuneEtablissement'))}), ''), 'N/A') as address,
    adresseEtablissement.codePostalEtablissement as postal, adresseEtablissement.libelleCommuneEtablissement as city, coalesce(etablissementSiege, false) as head from c)"""


def grid(spark, sf_dir):
    return R.search_row(latest(spark, sf_dir))


query("search_rows", GRID + " select * from g")(grid)
query("hq_sort_page", GRID + " select * from g order by head desc, (status = 'A') is true desc, siret limit 25 offset 25")(lambda s, d: R.page(grid(s, d), [C("head").desc(), (F.coalesce(C("status"), F.lit("")) == "A").desc(), C("siret")], 2, 25))
query("keyset_page", GRID + " select * from g where siret > '5' order by siret limit 100")(lambda s, d: R.after(grid(s, d), "siret", "5", 100))
query("facet_counts", GRID + " select activity, status, count(*) as n from g group by all")(lambda s, d: grid(s, d).groupBy("activity", "status").agg(F.count("*").alias("n")))
query("hq_active", GRID + " select siret, name from g where head and status = 'A'")(lambda s, d: grid(s, d).where(C("head").eqNullSafe(True) & (C("status") == "A")).select("siret", "name"))
query("grid_filter", GRID + " select siret, name, city from g where contains(lower(name), 'garage') and contains(lower(city), 'e')")(lambda s, d: grid(s, d).where(F.contains(F.lower("name"), F.lit("garage")) & F.contains(F.lower("city"), F.lit("e"))).select("siret", "name", "city"))
query("grid_sort", GRID + " select siret, activity, row_number() over (order by activity desc nulls last, siret) as place from g order by place limit 200")(lambda s, d: _placed(grid(s, d)))
query("establishments_per_siren", f"with {LATEST} select siren, count(*) as establishments from l group by siren")(lambda s, d: latest(s, d).groupBy("siren").agg(F.count("*").alias("establishments")))
query("latest_registry", f"with {LATEST} select siret, delivery_id from l")(lambda s, d: latest(s, d).select("siret", "delivery_id"))
query("siret_prefix", f"with {LATEST} select siret from l where siret like '12%'")(lambda s, d: latest(s, d).where(R.criteria(siret="12")).select("siret"))


def _placed(df):
    """The first 200 by activity from Z to A, those without last: a top-k, which needs no window over all."""
    top = df.orderBy(C("activity").desc_nulls_last(), "siret").limit(200)
    from pyspark.sql import Window

    return top.select("siret", "activity", F.row_number().over(Window.orderBy(C("activity").desc_nulls_last(), "siret")).alias("place"))


NAMED = f"({prefixes('uniteLegale.denominationUniteLegale', 'TRANS')} or coalesce(list_bool_or(list_transform(periodesEtablissement, lambda p: {prefixes('p.enseigne1Etablissement', 'TRANS')})), false) or coalesce(list_bool_or(list_transform(periodesEtablissement, lambda p: {prefixes('p.denominationUsuelleEtablissement', 'TRANS')})), false))"
query("lucene_name", f"with {LATEST} select siret from l where {NAMED}")(lambda s, d: latest(s, d).where(R.named("trans")).select("siret"))
query("lucene_multi", f"with {LATEST}, c as (select *, {CURRENT} as p from l) select siret from c where {prefixes('adresseEtablissement.libelleCommuneEtablissement', 'SAINT')} and {prefixes('adresseEtablissement.libelleVoieEtablissement', 'DE LA')} and p.etatAdministratifEtablissement = 'A'")(
    lambda s, d: latest(s, d).where(R.criteria(commune="Saint", address="de la", status="A")).select("siret"))
query("lucene_codes", f"with {LATEST}, c as (select *, {CURRENT} as p from l) select siret from c where uniteLegale.categorieJuridiqueUniteLegale = '5460' and adresseEtablissement.codePostalEtablissement like '9%'")(
    lambda s, d: latest(s, d).where(R.criteria(category="5460", department="9")).select("siret"))
T = f"list_filter(regexp_split_to_array(regexp_replace({fold('uniteLegale.denominationUniteLegale')}, '\\([^)]*\\)', ' ', 'g'), '[\\s\\-.''*/()\\[\\]]+'), lambda w: w <> '')"
query("strict_name_match", f"with {LATEST}, t as (select siret, {T} as t from l) select siret, list_contains(t, 'TRANSPORTS') as one, coalesce(list_bool_or(list_transform(t, lambda w: starts_with(w, 'TRANS'))), false) as prefix, coalesce(list_bool_or(list_transform(range(len(t)), lambda i: t[i + 1] = 'ET' and starts_with(t[i + 2], 'B'))), false) as phrase from t")(
    lambda s, d: latest(s, d).select("siret", *[R.strict_match(C("uniteLegale.denominationUniteLegale"), p, x).alias(n) for n, p, x in (("one", "transports", False), ("prefix", "Trans", True), ("phrase", "et b", False))]))


@query("tiered_search")
def tiered_search(spark, sf_dir):
    f = lambda k: C("fields").getItem(k)["value"]
    asked = table(spark, sf_dir, "extraction").groupBy(C("row_id").alias("id")).agg(F.min(f("company_name_raw")).alias("name"), F.min(f("postal_code")).alias("postal"), F.min(f("city")).alias("city"))
    return R.tiers(asked, latest(spark, sf_dir))


@query("bulk_dates", "with e as (select distinct row_id, regexp_extract(Transaction_Date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') as day, " + digits("Original_SIRET") + " as siret, " + digits("Original_SIREN") + " as siren from erp_row) select day, count(distinct case when length(siret) = 14 then siret end) as sirets, count(distinct case when length(siret) <> 14 and length(siren) = 9 then siren end) as sirens from e group by day")
def bulk_dates(spark, sf_dir):
    """Distinct identifiers to look up by date; a SIREN only where there is no SIRET."""
    e = table(spark, sf_dir, "erp_row").select(F.coalesce(F.regexp_extract("Transaction_Date", r"^\d{4}-\d{2}-\d{2}", 0)).alias("day"), N.digits(C("Original_SIRET")).alias("siret"), N.digits(C("Original_SIREN")).alias("siren"))
    return e.groupBy("day").agg(F.countDistinct(F.when(F.length("siret") == 14, C("siret"))).alias("sirets"), F.countDistinct(F.when((F.length("siret") != 14) & (F.length("siren") == 9), C("siren"))).alias("sirens"))


