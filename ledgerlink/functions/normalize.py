"""Names, identifiers, addresses, dates and numbers in normal form, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
LEGAL_FORMS = ["SARL", "SAS", "SASU", "SA", "EURL", "SCI", "SNC", "SELARL", "SELAS", "GIE", "ASSOCIATION"]
STOPWORDS = ["SOCIETE", "COMPAGNIE", "ENTREPRISE", "ET", "DE", "DU", "DES", "LA", "LE", "LES", "AU", "AUX"]
ABBREVIATIONS = {"ST": "SAINT", "STE": "SAINTE", "AV": "AVENUE", "BD": "BOULEVARD", "RTE": "ROUTE", "IMP": "IMPASSE"}
CITY_ALIASES = {"PARIS 01": "PARIS", "PARIS 1ER": "PARIS", "PARIS 1": "PARIS", "LYON 01": "LYON", "LYON 1ER": "LYON", "MARSEILLE CEDEX": "MARSEILLE", "ST ETIENNE": "SAINT ETIENNE"}
OCR_HINTS = {"S0CIETE": "SOCIETE", "5ARL": "SARL", "SASUU": "SASU", "PARlS": "PARIS", "L Y O N": "LYON"}
LEGAL_FORM_PATTERN = r"\b(SASU?|SARL|EURL|SA|SNC|SCI|SELARL|EI|EIRL)\b"
NOISE_PATTERN = r"\b(FACTURE|ACOMPTE|CMD|COMMANDE|BON|BC|BL|FOURNISSEUR|VIR|VIREMENT)\b"

#: White space as scripts see it, the no-break spaces included.
BLANK = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


@cache
def _accents(compatible: bool) -> tuple[str, str]:
    """Letters with accents and the letters without, by Unicode decomposition."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD" if compatible else "NFD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_accents(c: Column, compatible: bool = False) -> Column:
    return F.regexp_replace(F.translate(c, *_accents(compatible)), r"[\u0300-\u036f]", "")


def tidy(c: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def fold_french(c: Column) -> Column:
    """Ligatures written out and accents dropped; case stays."""
    for a, b in (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return strip_accents(c, compatible=True)


def base(c: Column) -> Column:
    """Upper case without accents; ligatures stay."""
    return tidy(strip_accents(F.upper(text(c))))


def comparable(c: Column) -> Column:
    return tidy(F.upper(fold_french(text(c))))


def alnum(c: Column) -> Column:
    """Upper case without accents, letters, digits and single blanks only."""
    return tidy(F.regexp_replace(strip_accents(F.upper(text(c))), "[^A-Z0-9 ]", " "))


def words(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: w != "")


def token(c: Column) -> Column:
    """The normal form as one word: what is no letter, digit or underscore is dropped, blanks too."""
    return F.regexp_replace(base(c), "[^A-Za-z0-9_]", "")


def strip_legal_forms(c: Column) -> Column:
    return F.concat_ws(" ", F.filter(words(base(c)), lambda w: ~w.isin(LEGAL_FORMS)))


def drop_stopwords(c: Column) -> Column:
    return F.filter(words(base(c)), lambda w: ~w.isin(STOPWORDS))


def core_name(c: Column) -> Column:
    """The name without legal forms as one word; the whole name where nothing else is left."""
    return token(F.coalesce(F.nullif(strip_legal_forms(c), F.lit("")), text(c)))


def expand_abbreviations(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.concat_ws(" ", F.transform(words(base(c)), lambda w: F.coalesce(F.try_element_at(table, w), w)))


def ocr_hints(c: Column) -> Column:
    out = base(c)
    for wrong, right in OCR_HINTS.items():
        out = F.regexp_replace(out, rf"\b{wrong}\b", right)
    return out


def city(c: Column) -> Column:
    out = expand_abbreviations(ocr_hints(c))
    table = F.create_map(*[F.lit(x) for kv in CITY_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, out), out)


def address(c: Column) -> Column:
    return tidy(F.regexp_replace(expand_abbreviations(ocr_hints(c)), r"[^A-Za-z0-9_\s]", " "))


def verified_core_name(c: Column) -> Column:
    """A name without legal forms and words of accounting; null where nothing is left."""
    out = F.regexp_replace(F.regexp_replace(base(c), LEGAL_FORM_PATTERN, " "), NOISE_PATTERN, " ")
    return F.nullif(tidy(out), F.lit(""))


def digits(c: Column) -> Column:
    return F.regexp_replace(text(c), "[^0-9]", "")


def fixed_digits(c: Column, size: int) -> Column:
    """The digits if there are ``size`` of them, else ''."""
    d = digits(c)
    return F.when(F.length(d) == size, d).otherwise("")


def padded_siret(c: Column) -> Column:
    """12 or 13 digits filled up to 14 with zeros in front; else null."""
    d = digits(c)
    return F.when(F.length(d).isin(12, 13), F.lpad(d, 14, "0"))


def repaired_number(c: Column) -> Column:
    """An identifier that a spreadsheet turned into scientific notation counts as absent, others stay."""
    t = F.trim(text(c))
    return F.when(F.replace(t, F.lit(","), F.lit(".")).rlike(r"^[0-9]+(\.[0-9]+)?[eE]\+?[0-9]+$"), F.lit("")).otherwise(t)


def department(c: Column, rule: str) -> Column:
    """The department of a postal code. ``search``: three digits for 97; ``score``: for 97 and 98, of the digits; ``plain``: two."""
    t = F.trim(text(c))
    if rule == "plain":
        return F.substring(t, 1, 2)
    if rule == "score":
        d = digits(c)
        return F.when(F.length(d) < 2, "").when(d.rlike("^9[78]"), F.substring(d, 1, 3)).otherwise(F.substring(d, 1, 2))
    if rule == "search":
        return F.when(F.length(t) < 2, "").when(t.startswith("97") & (F.length(t) >= 3), F.substring(t, 1, 3)).otherwise(F.substring(t, 1, 2))
    raise ValueError(rule)


def split_vat(vat: Column, country: Column) -> tuple[Column, Column]:
    """Country of two letters and number. The country given counts if it has two letters, else the number's own prefix."""
    v = F.upper(F.regexp_replace(text(vat), f"{BLANK}+", ""))
    given = F.substring(F.regexp_replace(F.upper(text(country)), "[^A-Z]", ""), 1, 2)
    own = (F.length(v) > 2) & v.rlike("^[A-Z]{2}")
    stated = F.length(given) == 2
    code = F.when(v == "", "").when(stated, given).when(own, F.substring(v, 1, 2)).otherwise("")
    number = F.when(stated & F.startswith(v, given), F.substring(v, 3, 99)).when(stated, v).when(own, F.substring(v, 3, 99)).otherwise(v)
    return code, number


def iso_date(c: Column) -> Column:
    """ISO dates kept, d/m/y and d-m-y reordered without a look at the calendar, else ''."""
    t = F.trim(text(c))
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    dmy = F.regexp_replace(F.regexp_extract(t, r"^(\d{2}[/-]\d{2}[/-]\d{4})$", 1), r"^(..).(..).(....)$", "$3-$2-$1")
    return F.concat(iso, dmy)


def first_present(*columns: Column) -> Column:
    """The first that is not blank, without outer blanks; '' if there is none."""
    return F.coalesce(*[F.nullif(F.trim(text(c)), F.lit("")) for c in columns], F.lit(""))


def yes_no(c: Column) -> Column:
    return F.when(F.lower(F.trim(text(c))).isin("true", "1", "yes", "y", "oui", "valid"), "Yes").otherwise("No")


def clamp01(c: Column) -> Column:
    """Kept within 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def pipe_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), r"\|"), tidy), lambda x: x != "")


def mojibake(c: Column) -> Column:
    """Text decoded as Latin-1 by mistake, decoded again where its marks are and it can be."""
    again = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    return F.when(c.rlike(r"Ã|Â|â") & c.rlike(r"^[\x00-\xff]*$"), F.coalesce(again, c)).otherwise(c)


def html_escape(c: Column) -> Column:
    out = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def thousands(c: Column) -> Column:
    return F.regexp_replace(text(c), r"\B(?=(\d{3})+(?!\d))", " ")


def short_hash(c: Column) -> Column:
    """Eight hexadecimal digits: h = (33 h + code) mod 2**31 from 5381 on, over the text's units of 16 bits."""
    units = F.filter(F.split(F.hex(F.encode(text(c), "UTF-16BE")), "(?<=\\G.{4})"), lambda x: x != "")
    h = F.aggregate(units, F.lit(5381).cast("bigint"), lambda h, x: F.pmod(h * 33 + F.conv(x, 16, 10).cast("bigint"), F.lit(2147483648)))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def json_in_text(c: Column) -> Column:
    """What stands from the first brace to the last; null if there are none."""
    return F.nullif(F.regexp_extract(text(c), r"(?s)(\{.*\})", 1), F.lit(""))
