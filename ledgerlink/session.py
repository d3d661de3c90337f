"""Session helpers: reading tables, cutting lineage, and finding keys too heavy for one task."""

from __future__ import annotations

import atexit
import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: No set of hot keys holds more keys than this: a key is hot only beyond total/HOT_KEYS rows, so that
#: there can't be more of them. It is the proven size bound of every broadcast of hot keys.
HOT_KEYS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once as a table to the shared checkpoint folder and read again from there.

    The folder is spark.checkpoint.dir; a folder of our own is used only where that is unset on one machine, as in tests.
    The table stays readable while the session lasts, whatever executors are lost, and is removed after it.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = os.path.join(tempfile.gettempdir(), "ledgerlink-checkpoint")
    path = f"{base}/ledgerlink-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if spark.sparkContext.applicationId not in _cleaned:
        _cleaned.add(spark.sparkContext.applicationId)
        atexit.register(_remove, spark, os.path.dirname(path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a table that ``cut`` wrote and nothing reads any more, as the last round's in a loop."""
    if path := getattr(df, "_cut_path", None):
        _remove(df.sparkSession, path)


_cleaned: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
    except Exception:  # the session is gone already
        pass


def packed(df: DataFrame, name: str) -> Column:
    """All columns of ``df`` in one struct, so that further columns can't clash with their names."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def piece_rows(total: int, least: int) -> int:
    """Rows that one task may hold of one key; keys with more are hot, and there are fewer than HOT_KEYS."""
    return max(least, math.ceil(total / HOT_KEYS))
