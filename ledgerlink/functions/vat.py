"""VAT numbers, the answers of a VAT register in their many shapes, and checks of what people type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlink.functions.normalize import BLANK, first_present, text

# Names under which registers give a field, in order of preference.
NAMES = ["name", "legalName", "legal_name", "traderName", "trader_name", "companyName", "company_name"]
ADDRESSES = ["address", "registeredAddress", "registered_address", "legalAddress", "legal_address", "traderAddress", "trader_address", "companyAddress", "company_address"]
NESTED = ["trader", "legal", "company"]
VALID = ["isValid", "valid", "is_valid"]
TRUE, FALSE = ["true", "valid", "yes", "1"], ["false", "invalid", "no", "0"]


def interactive_split(vat: Column, country: Column) -> tuple[Column, Column]:
    """Country and number as a person enters them: the country is not cut, a bare number needs two letters in front."""
    v = F.upper(F.regexp_replace(text(vat), f"{BLANK}+", ""))
    given = F.upper(F.trim(text(country)))
    pattern = r"^([A-Z]{2})([A-Z0-9+*]+)$"
    own = v.rlike(pattern)
    code = F.when(given != "", given).when(own, F.regexp_extract(v, pattern, 1)).otherwise("")
    number = F.when((given != "") & F.startswith(v, given), F.substr(v, F.length(given) + 1)).when(given != "", v).when(own, F.regexp_extract(v, pattern, 2)).otherwise(v)
    return code, number


def masked(c: Column) -> Column:
    """What an input field lets through: capitals, digits, + and *, at most 16."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.upper(text(c)), f"{BLANK}+", ""), "[^A-Z0-9+*]", ""), 1, 16)


def french(c: Column) -> Column:
    """The first French VAT number in a text, in capitals; '' if there is none."""
    return F.upper(F.regexp_extract(text(c), r"(?i)\b(FR[0-9A-Z]{2}[0-9]{9})\b", 1))


def _path(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "string")


def register_answer(payload: Column, country: Column, number: Column, nested: bool = False) -> dict[str, Column]:
    """Fields of a register's answer (a variant), by the first of their names that is filled.

    ``nested`` also reads names within trader, legal and company. Whether the number is valid is told
    twice: ``status`` takes any text but '' for true, as batches do; ``is_valid`` reads the text. Of the
    three names for it the first that is there counts, be it null.
    """
    pick = lambda names: first_present(*[_path(payload, n) for n in names])
    inner = lambda leaf: [f"{n}.{leaf}" for n in NESTED] if nested else []
    there = [F.schema_of_variant(F.try_variant_get(payload, f"$.{n}", "variant")) for n in VALID]
    kind = F.coalesce(*there, F.lit(""))
    value = F.lit(None).cast("string")
    for t, n in reversed(list(zip(there, VALID))):
        value = F.when(t.isNotNull(), _path(payload, n)).otherwise(value)
    low = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    truthy = F.when(kind == "STRING", F.coalesce(value, F.lit("")) != "").when(kind == "BOOLEAN", low == "true").when(kind.isin("VOID", ""), F.lit(False)).otherwise(F.coalesce(value.try_cast("double"), F.lit(0.0)) != 0)
    error = pick(["userError", "user_error"])
    name, address = pick([*NAMES, *inner("name")]), pick([*ADDRESSES, *inner("address")])
    return {
        "status": F.when(error != "", error).when(truthy, "VALID").otherwise("INVALID"),
        "is_valid": F.when(low.isin(TRUE), "Yes").otherwise("No"),
        "legal_name": name,
        "registered_address": address,
        "request_date": pick(["requestDate", "request_date"]),
        "country_code": first_present(_path(payload, "countryCode"), _path(payload, "country_code"), country),
        "vat_number": first_present(_path(payload, "vatNumber"), _path(payload, "vat_number"), number),
        "original_vat_number": first_present(_path(payload, "originalVatNumber"), _path(payload, "original_vat_number"), F.concat(country, number)),
    }


def validity(c: Column) -> Column:
    """A yes or no in words; other texts count as yes unless empty, null as no."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False).otherwise(F.coalesce(c, F.lit("")) != "")


def shown_number(country: Column, number: Column, original: Column) -> Column:
    """A VAT number with its country in front, once."""
    code, n = first_present(country), first_present(number)
    return F.when(code == "", first_present(number, original)).when(F.startswith(F.upper(n), F.upper(code)), n).otherwise(F.concat(code, n))


def address_lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def identifier_kind(c: Column) -> tuple[Column, Column]:
    """``siret`` or ``siren`` and the digits of what is typed with blanks and dashes; nulls for anything else."""
    t = F.regexp_replace(text(c), r"[\s-]", "")
    kind = F.when(t.rlike(r"^[0-9]{14}$"), "siret").when(t.rlike(r"^[0-9]{9}$"), "siren")
    return kind, F.when(kind.isNotNull(), t)


def acceptable_name(c: Column) -> Column:
    return F.length(F.trim(text(c))) >= 3


def acceptable_postal(c: Column) -> Column:
    return (text(c) == "") | text(c).rlike(r"^[0-9]{5}$")
