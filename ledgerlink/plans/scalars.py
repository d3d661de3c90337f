"""Scalar functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N
from ledgerlink.functions import similarity as S
from ledgerlink.plans.registry import query
from ledgerlink.session import table

WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def tidy(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def plain(x: str) -> str:
    return f"regexp_replace(strip_accents({x}), '[\\x{{0300}}-\\x{{036F}}]', '', 'g')"


def base(x: str) -> str:
    return tidy(plain(f"upper(coalesce({x}, ''))"))


def alnum(x: str) -> str:
    return tidy(f"regexp_replace({plain(f"upper(coalesce({x}, ''))")}, '[^A-Z0-9 ]', ' ', 'g')")


def listed(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def digits(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[^0-9]', '', 'g')"


def mapped(x: str, table_: dict) -> str:
    return f"coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in table_.items())}}}[{x}], {x})"


def stripped(x: str) -> str:
    return f"array_to_string(list_filter({words(base(x))}, lambda w: w not in ({listed(N.LEGAL_FORMS)})), ' ')"


def expanded(x: str) -> str:
    return f"array_to_string(list_transform({words(base(x))}, lambda w: {mapped('w', N.ABBREVIATIONS)}), ' ')"


def hinted(x: str) -> str:
    out = base(x)
    for a, b in N.OCR_HINTS.items():
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return out


def core(x: str) -> str:
    return f"regexp_replace({base(f"coalesce(nullif({stripped(x)}, ''), {x}, '')")}, '[^A-Za-z0-9_]', '', 'g')"


def family(x: str) -> str:
    t = alnum(x)
    tests = [(r"\bSASU?\b", "SAS_FAMILY"), (r"\b(SARL|EURL|SARLU)\b", "SARL_FAMILY"), (r"\bSA\b|\bSOCIETE ANONYME\b", "SA"), (r"\bSCI\b", "SCI"), (r"\b(EI|EIRL)\b|\bENTREPRENEUR INDIVIDUEL\b", "EI")]
    return "case " + " ".join(f"when regexp_matches({t}, '{p}') then '{v}'" for p, v in tests) + " else '' end"


def over(name: str, source: str, aliases: list[str], columns, sql: list[str]):
    """A query that adds expressions to a table; ``columns`` makes them once there is a session."""
    keys = ["row_id"] if source in ("erp_row", "extraction") else ["line_id"] if source == "upload_raw" else ["delivery_id"]
    body = ", ".join([*keys, *(f"{s} as {a}" for a, s in zip(aliases, sql))])

    @query(name, f"select {body} from {source}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(*keys, *[f.alias(a) for a, f in zip(aliases, columns())])

    return run


C = F.col
NAME = "Original_Name"
over("fold_text", "erp_row", ["folded", "comparable"], lambda: [N.fold_french(N.text(C(NAME))), N.comparable(C(NAME))],
     [plain(f"replace(replace(replace(replace(coalesce({NAME}, ''), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE')"), tidy(f"upper({plain(f"replace(replace(replace(replace(coalesce({NAME}, ''), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE')")})")])
over("normalize_base", "erp_row", ["base", "alnum", "token"], lambda: [N.base(C(NAME)), N.alnum(C(NAME)), N.token(C(NAME))], [base(NAME), alnum(NAME), f"regexp_replace({base(NAME)}, '[^A-Za-z0-9_]', '', 'g')"])
over("strip_legal", "erp_row", ["name"], lambda: [N.strip_legal_forms(C(NAME))], [stripped(NAME)])
over("core_name", "erp_row", ["core"], lambda: [N.core_name(C(NAME))], [core(NAME)])
over("drop_stopwords", "erp_row", ["kept"], lambda: [F.concat_ws(" ", N.drop_stopwords(C(NAME)))], [f"array_to_string(list_filter({words(base(NAME))}, lambda w: w not in ({listed(N.STOPWORDS)})), ' ')"])
over("expand_abbrev", "erp_row", ["address", "hinted"], lambda: [N.expand_abbreviations(C("Original_Address")), N.ocr_hints(C("Original_Address"))], [expanded("Original_Address"), hinted("Original_Address")])
over("normalize_city", "erp_row", ["city"], lambda: [N.city(C("Original_City"))], [mapped(f"({expanded(hinted('Original_City'))})", N.CITY_ALIASES)])
over("normalize_address", "erp_row", ["address"], lambda: [N.address(C("Original_Address"))], [tidy(f"regexp_replace({expanded(hinted('Original_Address'))}, '[^A-Za-z0-9_\\s]', ' ', 'g')")])
over("verified_core_name", "erp_row", ["core"], lambda: [N.verified_core_name(C(NAME))], [f"nullif({tidy(f"regexp_replace(regexp_replace({base(NAME)}, '{N.LEGAL_FORM_PATTERN}', ' ', 'g'), '{N.NOISE_PATTERN}', ' ', 'g')")}, '')"])
over("identifier_digits", "erp_row", ["siret", "siren", "padded", "repaired"], lambda: [N.fixed_digits(C("Original_SIRET"), 14), N.fixed_digits(C("Original_SIREN"), 9), N.padded_siret(C("Original_SIRET")), N.repaired_number(C("Original_SIRET"))],
     [f"case when length({digits('Original_SIRET')}) = 14 then {digits('Original_SIRET')} else '' end", f"case when length({digits('Original_SIREN')}) = 9 then {digits('Original_SIREN')} else '' end",
      f"case when length({digits('Original_SIRET')}) in (12, 13) then lpad({digits('Original_SIRET')}, 14, '0') end", r"case when regexp_full_match(replace(trim(coalesce(Original_SIRET, '')), ',', '.'), '[0-9]+(\.[0-9]+)?[eE]\+?[0-9]+') then '' else trim(coalesce(Original_SIRET, '')) end"])
CP = "trim(coalesce(Original_CP, ''))"
over("department_codes", "erp_row", ["search", "score", "plain"], lambda: [N.department(C("Original_CP"), "search"), N.department(C("Original_CP"), "score"), N.department(C("Original_CP"), "plain")],
     [f"case when length({CP}) < 2 then '' when {CP} like '97%' and length({CP}) >= 3 then {CP}[1:3] else {CP}[1:2] end",
      f"case when length({digits('Original_CP')}) < 2 then '' when regexp_matches({digits('Original_CP')}, '^9[78]') then {digits('Original_CP')}[1:3] else {digits('Original_CP')}[1:2] end", f"{CP}[1:2]"])
TD = "trim(coalesce(Transaction_Date, ''))"
DATE = rf"regexp_extract({TD}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) || regexp_replace(regexp_extract({TD}, '^([0-9]{{2}}[/-][0-9]{{2}}[/-][0-9]{{4}})$', 1), '^(..).(..).(....)$', '\3-\2-\1')"
over("date_normalize", "erp_row", ["day"], lambda: [N.iso_date(C("Transaction_Date"))], [DATE])
over("txn_date_detect", "extraction", ["day"], lambda: [F.coalesce(F.nullif(F.regexp_extract("row_text", r"\b(20\d{2}-\d{2}-\d{2})\b", 1), F.lit("")), F.nullif(N.iso_date(F.regexp_extract("row_text", r"\b(\d{2}[/-]\d{2}[/-]20\d{2})\b", 1)), F.lit("")))],
     [r"coalesce(nullif(regexp_extract(row_text, '\b(20[0-9]{2}-[0-9]{2}-[0-9]{2})\b', 1), ''), nullif(regexp_replace(regexp_extract(row_text, '\b([0-9]{2}[/-][0-9]{2}[/-]20[0-9]{2})\b', 1), '^(..).(..).(....)$', '\3-\2-\1'), ''))"])
over("first_present", "erp_row", ["value"], lambda: [N.first_present(C("Original_SIRET"), C("Original_SIREN"), C(NAME))], [f"coalesce(nullif(trim(Original_SIRET), ''), nullif(trim(Original_SIREN), ''), nullif(trim({NAME}), ''), '')"])
over("raw_hash", "erp_row", ["hash"], lambda: [N.short_hash(N.digits(C("Original_SIRET")))], [f"lpad(lower(printf('%x', list_reduce(list_prepend(5381::bigint, list_transform(list_filter(string_split({digits('Original_SIRET')}, ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)), lambda h, x: (h * 33 + x) % 2147483648))), 8, '0')"])
over("html_escape", "upload_raw", ["escaped"], lambda: [N.html_escape(C("raw"))], ["replace(replace(replace(replace(coalesce(raw, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"])
over("pipe_list", "upload_raw", ["parts"], lambda: [F.size(N.pipe_list(C("raw")))], [f"len(list_filter(list_transform(string_split(coalesce(raw, ''), '|'), lambda x: {tidy('x')}), lambda x: x <> ''))::int"])
over("legal_family", "erp_row", ["family"], lambda: [S.legal_family(C(NAME))], [family(NAME)])
query("mojibake_repair")(lambda spark, sf_dir: table(spark, sf_dir, "erp_row").select("row_id", N.mojibake(C(NAME)).alias("name")))
over("evidence_check", "extraction", ["backed"], lambda: [F.contains("row_text", F.col("fields").getItem("company_name_raw")["evidence_text"])], ["contains(row_text, fields['company_name_raw'].evidence_text)"])
over("street_parts", "erp_row", ["number", "street"], lambda: [F.regexp_extract(N.text(C("Original_Address")), r"^\s*(\d+)", 1), F.trim(F.regexp_replace(N.text(C("Original_Address")), r"^\s*\d+\s*", ""))], [r"regexp_extract(coalesce(Original_Address, ''), '^\s*([0-9]+)', 1)", r"trim(regexp_replace(coalesce(Original_Address, ''), '^\s*[0-9]+\s*', ''))"])
over("address_tokens", "erp_row", ["tokens"], lambda: [F.concat_ws(" ", F.slice(F.filter(N.drop_stopwords(C("Original_Address")), lambda w: F.length(w) >= 3), 1, 8))], [f"array_to_string(list_filter({words(base('Original_Address'))}, lambda w: w not in ({listed(N.STOPWORDS)}) and length(w) >= 3)[1:8], ' ')"])
over("id_extraction", "extraction", ["ids"], lambda: [F.concat_ws(" ", F.regexp_extract_all("row_text", F.lit(r"(\d{9,14})"), 1))], ["array_to_string(regexp_extract_all(row_text, '[0-9]{9,14}'), ' ')"])


@query("vat_split", "with v as (select line_id, upper(regexp_replace(coalesce(regexp_extract(raw, 'FR[0-9]{11}'), ''), '\\s', '', 'g')) as v from upload_raw) select line_id, case when v = '' then '' else v[1:2] end as country, v[3:] as number from v")
def vat_split(spark, sf_dir):
    country, number = N.split_vat(F.regexp_extract("raw", "(FR[0-9]{11})", 1), F.lit(""))
    return table(spark, sf_dir, "upload_raw").select("line_id", country.alias("country"), number.alias("number"))


PAIR = f"select row_id, {alnum(NAME)} as a, {alnum('u')} as b from (select e.row_id, e.{NAME}, max(t.uniteLegale.denominationUniteLegale) as u from erp_row e join etablissement t on t.siret = {digits('e.Original_SIRET')} group by all)"


@query("token_similarity", f"with p as ({PAIR}), s as (select *, list_distinct({words('a')}) as x, list_distinct({words('b')}) as y from p), n as (select *, len(list_intersect(x, y)) as n from s) select row_id, a, b, case when len(x) = 0 or len(y) = 0 then 0 else round(2.0 * n / (len(x) + len(y)), 6) end::double as dice, case when len(x) = 0 or len(y) = 0 then 0 else round(n / len(x), 6) end::double as containment, case when len(x) = 0 or len(y) = 0 then 0 else round(n / (len(x) + len(y) - n), 6) end::double as jaccard, case when len(x) = 0 or len(y) = 0 then 0 else round(n / greatest(len(x), len(y)), 6) end::double as overlap from n")
def token_similarity(spark, sf_dir):
    p = named_pairs(spark, sf_dir)
    a, b = C("a"), C("b")
    return p.select("row_id", "a", "b", *[F.round(f(a, b), 6).alias(n) for n, f in (("dice", S.dice), ("containment", S.containment), ("jaccard", S.jaccard), ("overlap", S.overlap))])


@query("jaro_winkler")
def jaro_winkler(spark, sf_dir):
    """Scored once for each distinct pair, then given back to the rows."""
    p = named_pairs(spark, sf_dir)
    scored = p.select("a", "b").distinct().withColumn("similarity", F.round(S.jaro_winkler(C("a"), C("b")), 6))
    return p.join(scored, ["a", "b"]).select("row_id", "a", "b", "similarity")


def named_pairs(spark, sf_dir):
    """The typed name of each ERP row and the registered one of its SIRET."""
    t = table(spark, sf_dir, "etablissement").groupBy("siret").agg(F.max("uniteLegale.denominationUniteLegale").alias("u"))
    e = table(spark, sf_dir, "erp_row").select("row_id", NAME, N.digits(C("Original_SIRET")).alias("siret"))
    return e.join(t, "siret").select("row_id", NAME, "u").distinct().select("row_id", N.alnum(C(NAME)).alias("a"), N.alnum(C("u")).alias("b"))
