"""Attributes as they were known at the time of an event (problem 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlink.session import packed, piece_rows

#: Outer white space that people leave around a typed value.
OUTER = r"^[\s\u00a0\u202f]+|[\s\u00a0\u202f]+$"


def known_at(events: DataFrame, versions: DataFrame, event_key: Column, event_day: Column, version_key: Column, version_day: Column, version_order: Column, shard_rows: int = 20_000) -> DataFrame:
    """Each event with the entity's version that was the latest known on the event's day.

    Returns ``event`` (all columns of ``events`` as a struct) and ``version`` (all columns of ``versions``
    as a struct, null if none was known by then); one row per row of ``events``.

    Of several versions known on one day the one greatest by ``version_order`` counts; versions without
    key or day are never known; events without key or day, or before the first version, have a null
    version. Repeated events are kept; empty inputs give no events or null versions. Columns of the two
    inputs may bear the same names.

    A key with more than ``shard_rows`` events is cut into shards of time, and a day that is still too
    large into salts. Each shard gets its own versions and, as carry-in, the last one before it; then all
    shards are merged in time order, independently of each other.
    """
    target = piece_rows(events.count(), shard_rows)
    e = events.select(packed(events, "_e"), event_key.alias("_k"), event_day.cast("date").alias("_d"))
    v = versions.select(packed(versions, "_v"), version_key.alias("_k"), version_day.cast("date").alias("_d"), version_order.alias("_o"))
    v = v.where("_k is not null and _d is not null").groupBy("_k", "_d").agg(F.max_by("_v", "_o").alias("_v"))

    daily = e.where("_k is not null and _d is not null").groupBy("_k", "_d").agg(F.count("*").alias("_n"))
    by_key = Window.partitionBy("_k")
    upto = by_key.orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heavy = daily.withColumns({"_all": F.sum("_n").over(by_key), "_upto": F.sum("_n").over(upto)}).where(F.col("_all") > target)
    shards = heavy.groupBy("_k", F.floor((F.col("_upto") - F.col("_n")) / target).alias("_s")).agg(F.min("_d").alias("lo"), F.ceil(F.sum("_n") / target).cast("int").alias("salts"))
    hot = shards.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("lo", "salts"))).alias("_m"))
    small = F.broadcast(hot)  # fewer than HOT_KEYS keys and twice as many shards, see piece_rows

    place = F.coalesce(F.size(F.filter("_m", lambda x: x["lo"] <= F.col("_d"))), F.lit(0)).alias("_s")
    place = F.when(F.col("_m").isNull(), F.lit(0)).otherwise(place)
    salts = F.when(F.col("_s") > 0, F.try_element_at("_m", F.col("_s"))["salts"]).otherwise(F.lit(1))
    e = e.join(small, "_k", "left").withColumn("_s", place).withColumn("_z", F.pmod(F.xxhash64("_e", F.monotonically_increasing_id()), salts).cast("int"))
    v = v.join(small, "_k", "left").withColumn("_s", place)

    last = v.where("_m is not null").groupBy("_k", "_s").agg(F.max_by(F.struct("_d", "_v"), "_d").alias("_x"))
    grid = hot.select("_k", "_m", F.explode(F.sequence(F.lit(0), F.size("_m"))).alias("_s"))
    before = by_key.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carry = grid.join(last, ["_k", "_s"], "left").withColumn("_x", F.last("_x", ignorenulls=True).over(before)).where("_s > 0 and _x is not null")
    carry = carry.select("_k", F.col("_x._d").alias("_d"), F.col("_x._v").alias("_v"), "_m", "_s")
    own = v.where("_m is null or _s > 0").select("_k", "_d", "_v", "_m", "_s")
    v = own.unionByName(carry).withColumn("_z", F.explode(F.sequence(F.lit(0), salts - 1)))

    both = e.select("_k", "_s", "_z", "_d", F.lit(1).alias("_i"), "_e").unionByName(v.select("_k", "_s", "_z", "_d", F.lit(0).alias("_i"), "_v"), allowMissingColumns=True)
    keyed = both.where("_k is not null and _d is not null")
    merge = Window.partitionBy("_k", "_s", "_z").orderBy("_d", "_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = keyed.withColumn("_v", F.last("_v", ignorenulls=True).over(merge)).where("_i = 1")
    rest = both.where("_i = 1 and (_k is null or _d is null)")
    return found.unionByName(rest).select(F.col("_e").alias("event"), F.col("_v").alias("version"))


def real_day(text: Column) -> Column:
    """The date of a typed ``YYYY-MM-DD``, ``dd/mm/yyyy``, ``dd-mm-yyyy`` or ``YYYY-MM-DDThh:mm:ss``; null if it is none."""
    t = F.regexp_replace(text, OUTER, "")
    iso = F.regexp_extract(t, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9])?$", 1)
    french = F.regexp_replace(F.regexp_extract(t, r"^([0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})$", 1), r"^(..).(..).(....)$", "$3-$2-$1")
    return F.try_to_date(F.nullif(F.concat(iso, french), F.lit("")), "yyyy-MM-dd")


def period_on(periods: Column, day: Column) -> Column:
    """Of an establishment's periods that hold on the ISO day, the one that begins last; of equals, the greatest."""
    holds = lambda p: (p["dateDebut"] <= day) & (p["dateDebut"] != "") & (F.coalesce(F.nullif(p["dateFin"], F.lit("")), F.lit("9999-12-31")) >= day)
    return F.array_max(F.filter(periods, holds))


def erp_attributes(erp: DataFrame, etab: DataFrame, shard_rows: int = 20_000) -> DataFrame:
    """ERP rows with the delivery known on their day and the period that held by it, once per ``row_id``.

    Rows without ``row_id``, without 14 digits in ``Original_SIRET`` or without a real date are no cases.
    A row imported several times counts once, by its least content.
    """
    rows = erp.select("row_id", F.regexp_replace("Original_SIRET", "[^0-9]", "").alias("siret"), real_day(F.col("Transaction_Date")).alias("day"))
    rows = rows.where("row_id is not null and length(siret) = 14 and day is not null").groupBy("row_id").agg(F.min(F.struct("siret", "day")).alias("x")).select("row_id", "x.siret", "x.day")
    known = etab.select("siret", "delivery_id", "dateDernierTraitementEtablissement", "periodesEtablissement")
    found = known_at(rows, known, F.col("siret"), F.col("day"), F.col("siret"), F.to_date("dateDernierTraitementEtablissement"), F.struct("dateDernierTraitementEtablissement", "delivery_id"), shard_rows)
    found = found.withColumn("period", period_on(F.col("version.periodesEtablissement"), F.date_format("event.day", "yyyy-MM-dd")))
    return found.select("event.row_id", "event.siret", "event.day", "version.delivery_id", F.col("period.dateDebut").alias("date_debut"), F.col("period.etatAdministratifEtablissement").alias("status"), F.col("period.enseigne1Etablissement").alias("sign"), F.col("period.activitePrincipaleEtablissement").alias("activity"))
