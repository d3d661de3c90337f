"""Enrichment of streams: repeated requests once, answers for a while, runs that resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlink.operators.registry import enriched


def deduplicated(requests: DataFrame, keys: list[str], time: str, within: str = "15 minutes") -> DataFrame:
    """Each request once within the time that its answer lives; state older than that is dropped."""
    return requests.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def seen_by_window(events: DataFrame, key: str, time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n"))


def unprocessed(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left of a run."""
    return rows.join(done.select(key), key, "left_anti")


def enrich_stream(uploads: DataFrame, registry: DataFrame, key: Column, out: str, checkpoint: str):
    """Micro-batches of uploads enriched and appended as Parquet; after a stop it goes on where it was, once for each batch."""

    def batch(df: DataFrame, number: int) -> None:
        enriched(df, registry, key).drop("etablissement").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return uploads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
