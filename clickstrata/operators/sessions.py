"""Gap-based sessions: one exchange and one sort by user serve the gap, the running number and the aggregate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickstrata.functions.events import session_id, total, total_where
from clickstrata.schemas import MARKETPLACE_SESSIONS, STOREFRONT_SESSIONS

GAP_SECONDS = 1800


def numbered(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """events with ``seq``, the number of the user's session: a new one begins after more than the gap in whole seconds."""
    order = Window.partitionBy("user_id").orderBy("event_ts", "event_id")
    before = F.lag("event_ts").over(order)
    starts = F.when(before.isNull() | (F.unix_timestamp("event_ts") - F.unix_timestamp(before) > gap_seconds), 1).otherwise(0)
    return events.withColumn("__starts", starts).withColumn("seq", F.sum("__starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__starts")


def _of(kind: str) -> Column:
    return F.col("event_type") == kind


def _first(column: str) -> Column:
    return F.min_by(column, F.struct("event_ts", "event_id")).alias(column)


def _finished(grouped: DataFrame) -> DataFrame:
    return grouped.withColumns(
        {
            "session_id": session_id(F.col("user_id"), F.col("session_start")),
            "duration_sec": F.unix_timestamp("session_end") - F.unix_timestamp("session_start"),
            "converted": F.col("n_purchases") > 0,
            "session_date": F.to_date("session_start"),
        }
    )


_SPAN = (F.min, "session_start"), (F.max, "session_end")


def marketplace_sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    held = numbered(events, gap_seconds).groupBy("user_id", "seq").agg(
        *[f("event_ts").alias(name) for f, name in _SPAN],
        F.count("*").alias("n_events"),
        F.count_if(_of("product_view")).alias("n_views"),
        F.count_if(_of("add_to_cart")).alias("n_carts"),
        F.count_if(_of("remove_from_cart")).alias("n_removes"),
        F.count_if(_of("purchase")).alias("n_purchases"),
        F.count_distinct("product_id").alias("n_products"),
        total_where(_of("purchase"), F.col("price")).alias("revenue"),
        F.min_by("category_l1", F.struct("event_ts", "event_id")).alias("first_category"),
        F.count_distinct("source_session_id").alias("n_source_sessions"),
    )
    return _finished(held).select(*MARKETPLACE_SESSIONS.fields)


def storefront_sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    counts = {"n_page_views": "page_view", "n_searches": "search", "n_product_views": "product_view", "n_add_to_cart": "add_to_cart", "n_begin_checkout": "begin_checkout", "n_purchases": "purchase"}
    held = numbered(events, gap_seconds).groupBy("user_id", "seq").agg(
        *[f("event_ts").alias(name) for f, name in _SPAN],
        F.count("*").alias("n_events"),
        *[F.count_if(_of(kind)).alias(name) for name, kind in counts.items()],
        total(F.col("order_value")).alias("revenue"),
        *[_first(c) for c in ("device_type", "country", "utm_source")],
    )
    return _finished(held).select(*STOREFRONT_SESSIONS.fields)


def event_window(events: DataFrame, low: dt.date, high: dt.date) -> DataFrame:
    """Events of the days that sessions starting from low to high can touch: a day on either side stitches midnight."""
    day = dt.timedelta(days=1)
    return events.where(F.col("event_date").between(F.lit(low - day), F.lit(high + day)))


def starting_in(sessions: DataFrame, low: dt.date, high: dt.date) -> DataFrame:
    return sessions.where(F.col("session_date").between(F.lit(low), F.lit(high)))
