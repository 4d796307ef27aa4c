"""Data-quality gates: each stage is one aggregate, whose row becomes named check results."""

from __future__ import annotations

import sys
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstrata.functions.events import total, total_where

MIN_ROWS, MONEY_TOLERANCE, CART_COVERAGE = 1000, Decimal("0.01"), 0.20


def _results(stats: DataFrame, checks: list[tuple[str, bool, str, str]]) -> DataFrame:
    """check, hard, passed, detail rows from a one-row aggregate; a null condition fails."""
    rows = F.array(*[F.struct(F.lit(name).alias("check"), F.lit(hard).alias("hard"), F.coalesce(F.expr(condition), F.lit(False)).alias("passed"), F.expr(f"cast({detail} as string)").alias("detail")) for name, hard, condition, detail in checks])
    return stats.select(F.explode(rows).alias("r")).select("r.*")


def silver_checks(events: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """events: the day's silver rows."""
    stats = events.agg(
        F.count("*").alias("n"),
        F.count_distinct("event_id").alias("ids"),
        F.count_if(F.col("user_id").isNull() | F.col("event_ts").isNull() | F.col("event_type").isNull()).alias("nulls"),
        F.count_if(F.col("price") < 0).alias("negative"),
    )
    return _results(stats, [("min_rows", True, f"n >= {min_rows}", "n"), ("unique_event_id", True, "ids = n", "n - ids"), ("no_null_keys", True, "nulls = 0", "nulls"), ("no_negative_price", True, "negative = 0", "negative")])


def gold_checks(events: DataFrame, categories: DataFrame, funnel: DataFrame) -> DataFrame:
    """One day's silver events against its category and funnel rows."""
    kind = F.col("event_type")
    silver = events.agg(F.count_if(kind == "purchase").alias("s_purchases"), total_where(kind == "purchase", F.col("price")).alias("s_revenue"))
    gold = categories.agg(F.coalesce(F.sum("purchases"), F.lit(0)).alias("g_purchases"), F.coalesce(total(F.col("revenue")), F.lit(0).cast("decimal(18,2)")).alias("g_revenue"))
    day = funnel.agg(F.count("*").alias("f_rows"), F.sum("sessions").alias("sessions"), F.sum("sessions_purchase").alias("bought"), F.max("session_conversion_rate").alias("conversion"), F.sum("purchase_without_cart").alias("no_cart"))
    # three rows of one
    stats = silver.crossJoin(gold).crossJoin(day)
    return _results(
        stats,
        [
            ("purchases_match", True, "s_purchases = g_purchases", "s_purchases - g_purchases"),
            ("revenue_match", True, f"abs(s_revenue - g_revenue) <= {MONEY_TOLERANCE}", "s_revenue - g_revenue"),
            ("funnel_exists", True, "f_rows > 0", "f_rows"),
            ("sessions_positive", True, "sessions > 0", "sessions"),
            ("purchase_sessions_bounded", True, "bought <= sessions", "bought"),
            ("conversion_in_range", True, "conversion between 0 and 1", "conversion"),
            ("cart_coverage", False, f"coalesce(1 - try_divide(no_cart, bought), 1.0) >= {CART_COVERAGE}", "round(1 - try_divide(no_cart, bought), 4)"),
        ],
    )


@dataclass(frozen=True)
class Verdict:
    lines: list[str]
    failed: bool


def verdict(results: DataFrame) -> Verdict:
    """PASS, FAIL and WARN lines; failed if a hard check did not pass."""
    rows = results.collect()  # one row for each check
    lines = [f"{'PASS' if r.passed else 'FAIL' if r.hard else 'WARN'} {r.check}: {r.detail}" for r in rows]
    return Verdict(lines, any(r.hard and not r.passed for r in rows))


def gate(results: DataFrame, out=None) -> int:
    """Print the verdict; 1 if a hard check failed."""
    found = verdict(results)
    print("\n".join(found.lines), file=out or sys.stdout)
    return int(found.failed)


def reconcile(bronze_ids: DataFrame, silver: DataFrame, quarantine_ids: DataFrame, key: str = "event_id") -> DataFrame:
    """By day: distinct ids in bronze, in silver, in quarantine, and in neither."""
    here = lambda df, name: df.select(key, "event_date").distinct().withColumn(name, F.lit(1))
    held = here(bronze_ids, "b").join(here(silver, "s").drop("event_date"), key, "left").join(here(quarantine_ids, "q").drop("event_date"), key, "left")
    return held.groupBy("event_date").agg(F.count("b").alias("bronze"), F.count("s").alias("silver"), F.count("q").alias("quarantine"), F.count_if(F.col("s").isNull() & F.col("q").isNull()).alias("lost"))
