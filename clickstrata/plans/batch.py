"""Batch plans: refresh silver from bronze by day, build gold for a range of days, check a day."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstrata import schemas
from clickstrata.operators import checks, marts, sessions
from clickstrata.operators.dedup import keep_first
from clickstrata.operators.refine import MARKETPLACE, STOREFRONT, Profile, labelled, rejects, valid_events
from clickstrata.session import Lake
from clickstrata.sources.sinks import make_folder, overwrite_partitions, read


def upserted(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """Existing and new events, the earliest ingested of each id."""
    return keep_first(existing.unionByName(arrived))


#: Days around those that arrive in which copies of an id are looked for.
LOOKBACK_DAYS = 7


def refresh_silver(spark: SparkSession, lake: Lake, profile: Profile = STOREFRONT, low: dt.date | None = None, high: dt.date | None = None, everything: bool = False, now: dt.datetime | None = None, lookback_days: int | None = LOOKBACK_DAYS) -> dict[str, int]:
    """Rebuild the event days that the bronze days touch, and the quarantine of those bronze days.

    The ids that arrive are looked up in the days of silver around theirs, ``lookback_days`` to either side (None: in all),
    so an id stays once even if its copies carry different days of that span; each day that loses a copy is rebuilt too. The
    span bounds what is read of silver: whole partitions elsewhere, and of those within only the ids, are left alone.
    """
    bronze = read(spark, lake.table(profile.raw.name), profile.raw)
    if not everything:
        today = dt.datetime.now(dt.UTC).date()
        bronze = bronze.where(F.col("ingest_date").between(F.lit(low or today), F.lit(high or today)))
    rows = labelled(bronze, profile, now=now).persist()
    try:
        arrived = valid_events(rows, profile)
        silver = read(spark, lake.table(profile.events.name), profile.events)
        days = [r[0] for r in arrived.select("event_date").distinct().collect()]  # one row for each day
        n_events = 0
        if days:
            near = silver
            if lookback_days is not None:
                span = dt.timedelta(days=lookback_days)
                near = silver.where(F.col("event_date").between(F.lit(min(days) - span), F.lit(max(days) + span)))
            others = near.where(~F.col("event_date").isin(days)).select("event_id", "event_date")
            days += [r[0] for r in others.join(arrived.select("event_id").distinct(), "event_id", "left_semi").select("event_date").distinct().collect()]
            merged = upserted(silver.where(F.col("event_date").isin(days)), arrived)
            overwrite_partitions(merged, lake.table(profile.events.name), profile.events, days)
            n_events = read(spark, lake.table(profile.events.name), profile.events).where(F.col("event_date").isin(days)).count()
        bad = rejects(rows, profile)
        n_bad = bad.count()
        bronze_days = [r[0] for r in bronze.select("ingest_date").distinct().collect()]
        if bronze_days:
            overwrite_partitions(bad, lake.table(profile.quarantine.name), profile.quarantine, bronze_days)
        return {"days": len(days), "events": n_events, "rejects": n_bad}
    finally:
        rows.unpersist()


def days_between(low: dt.date, high: dt.date) -> list[dt.date]:
    return [low + dt.timedelta(days=i) for i in range((high - low).days + 1)]


def build_gold(spark: SparkSession, lake: Lake, profile: Profile, low: dt.date, high: dt.date, gap_seconds: int = sessions.GAP_SECONDS) -> dict[str, DataFrame]:
    """Sessions and marts of the days from low to high, written by partition; days without rows are cleared."""
    events = read(spark, lake.table(profile.events.name), profile.events)
    near = sessions.event_window(events, low, high)
    marketplace = profile.name == MARKETPLACE.name
    tables = (schemas.MARKETPLACE_SESSIONS, schemas.MARKETPLACE_FUNNEL) if marketplace else (schemas.STOREFRONT_SESSIONS, schemas.STOREFRONT_FUNNEL)
    made = sessions.starting_in((sessions.marketplace_sessions if marketplace else sessions.storefront_sessions)(near, gap_seconds), low, high)
    days = days_between(low, high)
    overwrite_partitions(made, lake.table(tables[0].name), tables[0], days)
    stored = read(spark, lake.table(tables[0].name), tables[0]).where(F.col("session_date").between(F.lit(low), F.lit(high)))
    overwrite_partitions((marts.marketplace_funnel if marketplace else marts.storefront_funnel)(stored), lake.table(tables[1].name), tables[1], days)
    out = {"sessions": stored, "funnel": read(spark, lake.table(tables[1].name), tables[1])}
    if marketplace:
        categories = marts.category_daily(events.where(F.col("event_date").between(F.lit(low), F.lit(high))))
        overwrite_partitions(categories, lake.table(schemas.MARKETPLACE_CATEGORIES.name), schemas.MARKETPLACE_CATEGORIES, days)
        out["categories"] = read(spark, lake.table(schemas.MARKETPLACE_CATEGORIES.name), schemas.MARKETPLACE_CATEGORIES)
        out["agreement_ours"] = marts.agreement_ours(stored)
        out["agreement_source"] = marts.agreement_source(near, gap_seconds)
    return out


def check_day(spark: SparkSession, lake: Lake, stage: str, day: dt.date, min_rows: int = checks.MIN_ROWS, profile: Profile = MARKETPLACE) -> DataFrame:
    """Check results of a day's silver or gold rows."""
    events = read(spark, lake.table(profile.events.name), profile.events).where(F.col("event_date") == F.lit(day))
    if stage == "silver":
        return checks.silver_checks(events, min_rows)
    of = lambda table: read(spark, lake.table(table.name), table).where(F.col(table.partition) == F.lit(day))
    return checks.gold_checks(events, of(schemas.MARKETPLACE_CATEGORIES), of(schemas.MARKETPLACE_FUNNEL))


def register(spark: SparkSession, lake: Lake, prefix: str = "") -> None:
    """Create databases, their names after the prefix, and external tables over the lake's folders, and pick up partitions
    written by path."""
    for table in schemas.TABLES.values():
        make_folder(spark, lake.table(table.name))
        named = replace(table, name=f"{prefix}{table.name}")
        named.create(spark, lake.table(table.name))
        spark.sql(f"MSCK REPAIR TABLE {named.name}")


def unregister(spark: SparkSession, prefix: str = "") -> None:
    """Drop the databases of ``register``; the folders stay."""
    for layer in {name.split(".")[0] for name in schemas.TABLES}:
        spark.sql(f"DROP DATABASE IF EXISTS {prefix}{layer} CASCADE")
