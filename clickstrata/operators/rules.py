"""Declarative validation: an ordered set of named rules gives each row the names of those it violates."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstrata.schemas import CORRUPT

STOREFRONT_TYPES = ("page_view", "search", "product_view", "add_to_cart", "remove_from_cart", "begin_checkout", "purchase")
MARKETPLACE_TYPES = ("view", "cart", "remove_from_cart", "purchase")


@dataclass(frozen=True)
class Rule:
    """violated is true where a row breaks the rule; null counts as kept."""

    name: str
    violated: Column


def _common(types: tuple[str, ...], floor: str, now: dt.datetime | None) -> list[Rule]:
    at = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp") if now else F.current_timestamp()
    ts, kind = F.col("event_ts"), F.col("event_type")
    return [
        Rule("malformed_json", F.col(CORRUPT).isNotNull()),
        Rule("null_event_id", F.col("event_id").isNull()),
        Rule("null_user_id", F.col("user_id").isNull()),
        Rule("bad_event_ts", ts.isNull() | (ts < F.lit(floor).cast("timestamp")) | (ts > at + F.expr("INTERVAL 1 DAY"))),
        Rule("bad_event_type", ~F.coalesce(kind.isin(*types), F.lit(False))),
        Rule("negative_price", F.col("price") < 0),
    ]


def marketplace_rules(floor: str = "2015-01-01", now: dt.datetime | None = None) -> list[Rule]:
    return _common(MARKETPLACE_TYPES, floor, now)


def storefront_rules(floor: str = "2020-01-01", now: dt.datetime | None = None) -> list[Rule]:
    return [*_common(STOREFRONT_TYPES, floor, now), Rule("bad_quantity", F.col("quantity") <= 0)]


def checked(df: DataFrame, rules: list[Rule], out: str = "reject_reasons") -> DataFrame:
    """df with the comma-joined names of the violated rules, '' for a valid row."""
    return df.withColumn(out, F.concat_ws(",", *[F.when(F.coalesce(r.violated, F.lit(False)), F.lit(r.name)) for r in rules]))
