"""What a free row of cells says: identifiers, kinds of words, search phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N

INVOICE = r"\b(FACTURE|INVOICE|REF|REFERENCE|BON|BC|BL)\b"
PHONE = r"\b0[1-9][0-9]{8}\b"


def escape_search(c: Column) -> Column:
    """Text for a search engine: punctuation as blanks, accents dropped, other special characters behind a backslash."""
    bare = N.fold_french(F.regexp_replace(N.text(c), r"['.\-_&+,;:!]", " "))
    return F.regexp_replace(bare, r'([+&|!(){}\[\]^"~?:\\/])', r"\\$1")


def exact_ids(cells: Column) -> tuple[Column, Column]:
    """First SIRET and first SIREN in cells without the letter e, which might be in scientific notation; a SIREN is derived from a SIRET."""
    joined = F.array_join(F.filter(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), lambda x: ~x.rlike("[eE]")), " ")
    found = F.regexp_extract_all(joined, F.lit(r"([0-9]{9,14})"), 1)
    siret = F.get(F.filter(found, lambda x: F.length(x) == 14), 0)
    return siret, F.coalesce(F.get(F.filter(found, lambda x: F.length(x) == 9), 0), F.substring(siret, 1, 9))


def word_kind(w: Column) -> Column:
    """``noise`` for stop words, accounting, telephones and what is too short, ``identity`` for identifiers, else ``supporting``.

    As the rules apply in this order, a bare identifier is noise: five digits and more are, whatever they are.
    """
    t = N.token(w)
    noise = (t == "") | t.isin(N.STOPWORDS) | t.rlike(f"(?i){INVOICE}") | t.rlike(PHONE) | (t.rlike(r"^[A-Z]*[0-9]{5,}$"))
    return F.when(noise, "noise").when(t.rlike(r"^([0-9]{9}|[0-9]{14})$"), "identity").when(t.isin(N.LEGAL_FORMS), "supporting").when(F.length(t) <= 2, "noise").otherwise("supporting")


def row_words(cells: Column, kind: str) -> Column:
    """The different words of a kind in all cells, in order."""
    split = F.flatten(F.transform(cells, lambda x: F.split(F.coalesce(x, F.lit("")), r"[\s,;|/\\-]+")))
    return F.array_distinct(F.filter(split, lambda w: (w != "") & (word_kind(w) == kind)))


def expanded_name(c: Column) -> Column:
    return N.expand_abbreviations(N.ocr_hints(F.coalesce(F.nullif(N.strip_legal_forms(c), F.lit("")), N.text(c))))


def acronym(c: Column) -> Column:
    """Initials of the words of two letters and more; '' for fewer than two."""
    a = F.array_join(F.transform(F.filter(N.words(expanded_name(c)), lambda w: F.length(w) >= 2), lambda w: F.substring(w, 1, 1)), "")
    return F.when(F.length(a) >= 2, a).otherwise("")


def canonical_postal(c: Column) -> Column:
    """Digits filled up to five; a missing postal code becomes 00000, which contradicts every other."""
    d = N.digits(c)
    return F.when(F.length(d) > 5, d).otherwise(F.lpad(d, 5, "0"))


def canonical_department(c: Column) -> Column:
    p = canonical_postal(c)
    return F.when(p.rlike("^9[78]"), F.substring(p, 1, 3)).otherwise(F.substring(p, 1, 2))


def xml_escape(c: Column) -> Column:
    return F.replace(N.html_escape(c), F.lit("'"), F.lit("&apos;"))


def csv_cell(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(N.text(c), F.lit('"'), F.lit('""')), F.lit('"'))


def leading_number(c: Column, fallback: float) -> Column:
    """The number that a text begins with, whatever follows it; else the fallback."""
    return F.coalesce(F.regexp_extract(F.trim(N.text(c)), r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double"), F.lit(fallback))
