"""De-duplication by event id, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str = "event_id", order: tuple[str | Column, ...] = ("ingest_ts",)) -> DataFrame:
    """One row for each key: the first in the order, all other columns breaking ties, so that re-runs agree."""
    names = {str(o) for o in order if isinstance(o, str)} | {key}
    rest = [F.col(c) for c in df.columns if c not in names]
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order, *rest)))
    return ranked.where("__n = 1").drop("__n")


def within_watermark(df: DataFrame, watermark: str = "24 hours", time: str = "event_ts", key: str = "event_id") -> DataFrame:
    """Streaming: the first event of each id within the watermark. Put after validation, so junk times cannot advance it."""
    return df.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def new_rows(df: DataFrame, existing: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows whose key is not there yet."""
    return df.join(existing.select(key), key, "left_anti")
