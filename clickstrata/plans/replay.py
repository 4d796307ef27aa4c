"""Replay of a marketplace CSV export: event ids, JSON payloads, and pacing."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickstrata.functions.events import event_hash, event_time


def with_event_ids(rows: DataFrame) -> DataFrame:
    """event_id: a hash of all values and the number of equal rows before it, whatever the order of the input."""
    columns = rows.columns
    same = Window.partitionBy(*columns).orderBy(F.lit(0))
    return rows.withColumn("event_id", F.concat_ws("-", event_hash(*[F.col(c) for c in columns]), (F.row_number().over(same) - 1).cast("string")))


def payloads(rows: DataFrame) -> DataFrame:
    """user_id, event_time, payload: compact JSON without empty fields; a price that is no number stays text, ids stay text."""
    held = rows.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in rows.columns])
    number = F.col("price").try_cast("double")
    as_json = lambda price: F.to_json(F.struct("event_id", *[c for c in held.columns if c not in ("event_id", "price")], price.alias("price")))
    return held.select("user_id", "event_time", F.when(number.isNotNull() | F.col("price").isNull(), as_json(number)).otherwise(as_json(F.col("price"))).alias("payload"))


@dataclass
class Summary:
    sent: int = 0
    skipped: int = 0
    first: dt.datetime | None = None
    last: dt.datetime | None = None


def paced(rows: Iterable, speedup: float = 1000, max_events: int = 0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator:
    """Rows (event_ts, ...) in order, each when its distance from the first, divided by speedup, has passed; 0 does not wait."""
    begin = first = None
    for n, row in enumerate(rows):
        if max_events and n >= max_events:
            return
        if speedup and row.event_ts is not None:
            if first is None:
                begin, first = clock(), row.event_ts
            wait = (row.event_ts - first).total_seconds() / speedup - (clock() - begin)
            if wait > 0:
                sleep(wait)
        yield row


def limited(rows: DataFrame, max_events: int = 0) -> DataFrame:
    """user_id, event_time, payload and event_ts of rows with ids; with ``max_events`` the first so many in event order."""
    held = payloads(rows).withColumn("event_ts", event_time(F.col("event_time")))
    return held.orderBy(*ORDER).limit(max_events) if max_events else held


#: Event order, total: rows of one time by user and payload, which holds the event's id.
ORDER = ("event_ts", "user_id", "payload")


def replay(rows: DataFrame, send: Callable[[str, str], None] | None = None, speedup: float = 1000, max_events: int = 0, skipped: int = 0, progress_every: int = 100_000, report: Callable[[Summary], None] = print, **timing) -> Summary:
    """Send payloads one by one in event order, one partition of rows at a time; without ``send`` they are only counted.

    For one process that stands for a shop; ``replay_slices`` sends from the executors.
    """
    ordered = limited(with_event_ids(rows), max_events).orderBy(*ORDER)
    out = Summary(skipped=skipped)
    try:
        for row in paced(ordered.toLocalIterator(), speedup, max_events, **timing):
            if send is not None:
                send(row.user_id, row.payload)
            out.sent += 1
            out.first = out.first or row.event_ts
            out.last = row.event_ts or out.last
            if progress_every and out.sent % progress_every == 0:
                report(out)
    except KeyboardInterrupt:
        pass
    return out


def replay_slices(rows: DataFrame, write: Callable[[DataFrame], None], folder: str, speedup: float = 1000, slice_seconds: float = 5, max_events: int = 0, skipped: int = 0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep, report: Callable[[Summary], None] = lambda out: None) -> Summary:
    """Send payloads from the executors, a slice of event time after the other, each when it is due.

    Rows are written once below ``folder``, by slice, so that a slice reads its own rows only; write(slice) gets rows
    (user_id, payload, event_ts) dealt by user and in event order, as a keyed sink needs them. The driver only waits. Rows
    without a time go with the first slice.
    """
    spark = rows.sparkSession
    held = limited(with_event_ids(rows), max_events)
    width = max(slice_seconds * speedup, 1e-3)
    stored = f"{folder}/replay-{uuid.uuid4().hex}"
    span = held.agg(F.min("event_ts").alias("low"), F.max("event_ts").alias("high")).first()
    seconds = lambda c: F.unix_micros(c) / 1e6
    number = F.coalesce(F.floor((seconds(F.col("event_ts")) - seconds(F.lit(span.low).cast("timestamp"))) / width), F.lit(0)).cast("int")
    held.withColumn("slice", number).write.partitionBy("slice").parquet(stored)
    sliced = spark.read.schema("user_id string, event_time string, payload string, event_ts timestamp, slice int").parquet(stored)
    counts = {r["slice"]: r["count"] for r in sliced.groupBy("slice").count().collect()}  # one row a slice
    out, begin = Summary(skipped=skipped, first=span.low, last=span.high), clock()
    try:
        for k in sorted(counts):
            if speedup and (wait := k * slice_seconds - (clock() - begin)) > 0:
                sleep(wait)
            write(sliced.where(F.col("slice") == k).select("user_id", "payload", "event_ts").repartition("user_id").sortWithinPartitions(*ORDER))
            out.sent += counts[k]
            report(out)
    except KeyboardInterrupt:
        pass
    return out
