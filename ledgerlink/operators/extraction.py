"""Extracted fields held against the text that they were taken from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.functions import normalize as N

# The fields of an extraction.
FIELDS = ["company_name_raw", "company_name_core", "city", "postal_code", "siren", "siret", "legal_form", "transaction_date", "address_fragment"]
SIZES = {"siren": 9, "siret": 14, "postal_code": 5}


def normal_form(name: str, value: Column) -> Column:
    """The field's value in the form that its kind asks for; null where it has none."""
    if name in SIZES:
        return F.nullif(N.fixed_digits(value, SIZES[name]), F.lit(""))
    if name == "transaction_date":
        return F.nullif(N.iso_date(value), F.lit(""))
    if name == "city":
        return F.nullif(N.base(value), F.lit(""))
    if name == "company_name_core":
        return N.verified_core_name(value)
    return value


def verified(extraction: DataFrame) -> DataFrame:
    """``row_id, parse_status, invalid_field_count, flags, fields``: what of each row's fields its text bears out.

    A field whose evidence isn't in the row's text, letter by letter, or whose value hasn't the form of its
    kind, is emptied and flagged; a blank one is empty without a flag. Confidences are kept within 0 and 1.
    A row without any value is ``empty``, one with flags ``low_confidence``, others keep their status or are
    ``parsed``. A repeated row_id is one row, by its least content; null row_ids are left out.
    """
    names = F.array(*[F.lit(n) for n in FIELDS])
    item = lambda n: F.col("fields").getItem(n)
    given = F.array(*[F.struct(F.trim(item(n)["value"]).alias("value"), item(n)["evidence_text"].alias("evidence"), N.clamp01(F.coalesce(item(n)["confidence"], F.lit(0.0))).alias("confidence")) for n in FIELDS])
    one = extraction.where("row_id is not null").select("row_id", "parse_status", F.coalesce("row_text", F.lit("")).alias("text"), given.alias("g"))
    one = one.groupBy("row_id").agg(F.min(F.struct("parse_status", "text", "g")).alias("x")).select("row_id", "x.*")
    cells, flags, steps = [], [], {}
    for k, n in enumerate(FIELDS):
        g, value = F.get("g", k), F.col(f"_v{k}")
        filled = F.coalesce(g["value"], F.lit("")) != ""
        backed = (F.coalesce(g["evidence"], F.lit("")) != "") & F.contains("text", F.coalesce(g["evidence"], F.lit("")))
        steps[f"_s{k}"] = F.when(filled & backed, g["value"])
        wrong = "company_name_core:empty_after_normalization" if n == "company_name_core" else f"{n}:invalid_format"
        flags.append(F.when(filled & F.col(f"_s{k}").isNull(), F.lit(f"{n}:evidence_not_in_row")).when(filled & value.isNull() & F.lit(n != "city"), F.lit(wrong)))
        cells.append(F.struct(value.alias("value"), F.when(value.isNotNull(), g["evidence"]).alias("evidence_text"), F.when(value.isNotNull(), g["confidence"]).otherwise(0.0).alias("confidence")))
    one = one.withColumns(steps).withColumns({f"_v{k}": normal_form(n, F.col(f"_s{k}")) for k, n in enumerate(FIELDS)})
    out = one.select("row_id", "parse_status", F.array_compact(F.array(*flags)).alias("flags"), F.map_from_arrays(names, F.array(*cells)).alias("fields"))
    any_value = F.exists(F.map_values("fields"), lambda v: v["value"].isNotNull())
    status = F.when(~any_value, "empty").when(F.size("flags") > 0, "low_confidence").when(F.col("parse_status").isin("parsed", "low_confidence"), F.col("parse_status")).otherwise("parsed")
    return out.select("row_id", status.alias("parse_status"), F.size("flags").alias("invalid_field_count"), "flags", "fields")


def readiness(rows: DataFrame) -> DataFrame:
    """Verified rows with ``extract_confidence`` (mean over the identifying fields), ``readiness`` for a search and ``next_action``."""
    v = lambda n: F.col("fields").getItem(n)["value"].isNotNull()
    used = [n for n in FIELDS if n not in ("legal_form", "address_fragment")]
    mean = sum(F.col("fields").getItem(n)["confidence"] for n in used) / len(used)
    named = v("company_name_core") | v("company_name_raw")
    ready = F.when(v("siret"), 0.98).when(v("siren"), 0.9).when(named & (v("city") | v("postal_code")), 0.75).when(named, 0.58).otherwise(0.2)
    ready = F.when(F.col("parse_status") == "low_confidence", ready * 0.85).when(F.col("parse_status") == "empty", F.least(ready, F.lit(0.35))).otherwise(ready)
    action = F.when(v("siret") | v("siren"), "DIRECT_LOOKUP").when(named, "SEARCH").when(F.col("parse_status") == "empty", "NEEDS_MORE_DATA").otherwise("MANUAL_REVIEW")
    return rows.withColumns({"extract_confidence": mean, "readiness": ready, "next_action": action})


def better_attempt(first: DataFrame, retry: DataFrame) -> DataFrame:
    """Of two verified attempts the one with fewer invalid fields, of equals the first; rows of either alone are kept."""
    both = first.withColumn("_a", F.lit(0)).unionByName(retry.withColumn("_a", F.lit(1)))
    columns = [c for c in first.columns if c != "row_id"]
    best = both.groupBy("row_id").agg(F.min_by(F.struct(*columns), F.struct("invalid_field_count", "_a")).alias("_x"))
    return best.select("row_id", *[F.col("_x")[c].alias(c) for c in columns])
