"""Bronze to silver: parse payloads, check them, and branch into valid events and labelled rejects."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickstrata import schemas
from clickstrata.functions.events import category_l1, event_time, money
from clickstrata.operators.rules import Rule, checked, marketplace_rules, storefront_rules


@dataclass(frozen=True)
class Profile:
    """One event family: its payload, its rules and its tables."""

    name: str
    payload: T.StructType
    time_field: str
    rules: Callable[..., list[Rule]]
    floor: str
    raw: schemas.Table
    events: schemas.Table
    quarantine: schemas.Table


STOREFRONT = Profile("storefront", schemas.STOREFRONT_JSON, "event_ts", storefront_rules, "2020-01-01", schemas.STOREFRONT_RAW, schemas.STOREFRONT_EVENTS, schemas.STOREFRONT_QUARANTINE)
MARKETPLACE = Profile("marketplace", schemas.MARKETPLACE_JSON, "event_time", marketplace_rules, "2015-01-01", schemas.MARKETPLACE_RAW, schemas.MARKETPLACE_EVENTS, schemas.MARKETPLACE_QUARANTINE)
PROFILES = {p.name: p for p in (STOREFRONT, MARKETPLACE)}


def parsed(bronze: DataFrame, profile: Profile) -> DataFrame:
    """Envelope columns and the payload's fields; fields are null and the corrupt column set for broken JSON."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    envelope = [c for c in bronze.columns if c not in profile.payload.fieldNames()]
    held = bronze.select(*envelope, F.from_json("raw_payload", profile.payload, options).alias("__j")).select(*envelope, "__j.*")
    return held.withColumn("event_ts", event_time(F.col(profile.time_field)))


def labelled(bronze: DataFrame, profile: Profile, floor: str | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Parsed rows with reject_reasons."""
    return checked(parsed(bronze, profile), profile.rules(floor or profile.floor, now))


def valid_events(rows: DataFrame, profile: Profile) -> DataFrame:
    """Labelled rows without reasons, as silver events (not yet de-duplicated)."""
    held = rows.where("reject_reasons = ''").withColumns({"event_date": F.to_date("event_ts"), "price": money(F.col("price"))})
    if profile.name == STOREFRONT.name:
        held = held.withColumn("order_value", money(F.col("order_value")))
    else:
        kind = F.col("event_type")
        held = held.withColumns({"event_type": F.when(kind == "view", "product_view").when(kind == "cart", "add_to_cart").otherwise(kind), "category_l1": category_l1(F.col("category_code")), "source_session_id": F.col("user_session")})
    return held.select(*profile.events.fields)


def rejects(rows: DataFrame, profile: Profile) -> DataFrame:
    return rows.where("reject_reasons <> ''").select(*profile.quarantine.fields)
