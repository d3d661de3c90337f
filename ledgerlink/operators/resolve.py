"""Resolution by several strategies, merging of candidates, grid filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Establishments of a SIREN that are counted as candidates.
MOST_CANDIDATES = 20


def by_siren(rows: DataFrame, registry: DataFrame, siren: Column) -> DataFrame:
    """Rows with ``siret``, ``candidate_count`` and ``several``: the head office of their SIREN, else its least SIRET.

    The registry is reduced to one row for each SIREN first, so that no row is multiplied by the units of a
    large one. Rows without a known SIREN have null siret and candidate_count.
    """
    head = ~F.coalesce("etablissementSiege", F.lit(False))
    units = registry.where("siren is not null").groupBy(F.col("siren").alias("_siren")).agg(F.min_by("siret", F.struct(head, "siret")).alias("siret"), F.count("*").alias("_n"))
    out = rows.withColumn("_key", siren).join(units, F.col("_key") == F.col("_siren"), "left")
    return out.withColumns({"candidate_count": F.when(F.col("_n").isNotNull(), F.least("_n", F.lit(MOST_CANDIDATES))), "several": F.col("_n") > 1}).drop("_key", "_siren", "_n")


def first_resolved(strategies: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """``key, value, strategy``: what the first strategy, in the order given, has for each key; of several the least."""
    names = F.array(*[F.lit(n) for n in strategies])
    every = reduce(DataFrame.unionByName, [df.select(key, value, F.lit(i).alias("_way")) for i, df in enumerate(strategies.values())])
    best = every.groupBy(key).agg(F.min(F.struct("_way", value)).alias("_x"))
    return best.select(key, F.col(f"_x.{value}").alias(value), F.get(names, F.col("_x._way")).alias("strategy"))


def merged(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """All keys of the frames once, with ``source``: the number, from 1, of the first frame that has it."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source", F.lit(i)) for i, df in enumerate(frames, 1)])
    return every.groupBy(*key).agg(F.min("source").alias("source"))


def contains_all(rows: DataFrame, boxes: dict[str, str]) -> DataFrame:
    """Rows whose columns contain what the boxes say, whatever the case; an empty box lets all pass, null is ''."""
    tests = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(x.lower())) for c, x in boxes.items() if x]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def page_info(pages: DataFrame, size: int) -> DataFrame:
    """``page, first, last, pages`` of rows with ``n`` and ``page``; pages behind the last are left out."""
    first = (F.col("page") - 1) * size
    return pages.where(first < F.col("n")).select("page", (first + 1).alias("first"), F.least(first + size, F.col("n")).alias("last"), F.ceil(F.col("n") / size).alias("pages"))


def sorting_or_cursor(tri: str | None, curseur: str | None) -> None:
    """Raises where a search asks for an order and a cursor at once, which exclude each other."""
    if tri and curseur:
        raise ValueError("tri and curseur exclude each other")


def visible_columns(available: list[str], shown: list[str], default: list[str]) -> list[str]:
    """Columns still there of those shown, the default ones where none is left."""
    kept = [c for c in shown if c in available]
    return kept or [c for c in default if c in available]
