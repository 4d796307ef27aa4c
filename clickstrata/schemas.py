"""One registry of table and payload schemas: struct types, DDL and column order come from here.

Money is decimal(18,2): sums of doubles depend on how rows are dealt to tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

MONEY = "decimal(18,2)"
CORRUPT = "_corrupt_record"

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "date": T.DateType(), MONEY: T.DecimalType(18, 2)}


def struct(columns: str) -> T.StructType:
    """The struct of ``name type, ...``, without a running Spark."""
    pairs = (c.rsplit(" ", 1) for c in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


@dataclass(frozen=True)
class Table:
    """name: layer.table; columns: DDL in order, the partition column last."""

    name: str
    columns: str
    partition: str
    format: str = "orc"

    @property
    def struct(self) -> T.StructType:
        return struct(self.columns)

    @property
    def fields(self) -> list[str]:
        return self.struct.fieldNames()

    def ddl(self, location: str) -> str:
        return f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}) USING {self.format} PARTITIONED BY ({self.partition}) LOCATION '{location}'"

    def create(self, spark: SparkSession, location: str) -> None:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.name.split('.')[0]}")
        spark.sql(self.ddl(location))


_ENVELOPE = "raw_payload string, source string, source_ref string, kafka_partition int, kafka_offset bigint, source_ts timestamp, ingest_ts timestamp, ingest_date date"
_QUARANTINE = "raw_payload string, source_ref string, ingest_ts timestamp, reject_reasons string, ingest_date date"

STOREFRONT_JSON = struct(
    "event_id string, event_ts string, user_id string, event_type string, page_url string, product_id string, category string, price double, quantity int, order_id string, order_value double, "
    f"device_type string, os string, browser string, country string, referrer string, utm_source string, utm_campaign string, {CORRUPT} string"
)
MARKETPLACE_JSON = struct(
    f"event_id string, event_time string, event_type string, product_id string, category_id string, category_code string, brand string, price double, user_id string, user_session string, {CORRUPT} string"
)
#: The columns of a marketplace CSV export, in order.
MARKETPLACE_CSV = struct("event_time string, event_type string, product_id string, category_id string, category_code string, brand string, price string, user_id string, user_session string")

STOREFRONT_RAW = Table("bronze.clickstream_raw", _ENVELOPE, "ingest_date", "parquet")
MARKETPLACE_RAW = Table("bronze.marketplace_raw", _ENVELOPE, "ingest_date", "parquet")
STOREFRONT_EVENTS = Table(
    "silver.events",
    f"event_id string, event_ts timestamp, user_id string, event_type string, page_url string, product_id string, category string, price {MONEY}, quantity int, order_id string, order_value {MONEY}, "
    "device_type string, os string, browser string, country string, referrer string, utm_source string, utm_campaign string, ingest_ts timestamp, event_date date",
    "event_date",
)
MARKETPLACE_EVENTS = Table(
    "silver.marketplace_events",
    f"event_id string, event_ts timestamp, event_type string, product_id string, category_id string, category_code string, category_l1 string, brand string, price {MONEY}, user_id string, "
    "source_session_id string, ingest_ts timestamp, event_date date",
    "event_date",
)
STOREFRONT_QUARANTINE = Table("silver.events_quarantine", _QUARANTINE, "ingest_date")
MARKETPLACE_QUARANTINE = Table("silver.marketplace_quarantine", _QUARANTINE, "ingest_date")
STOREFRONT_SESSIONS = Table(
    "gold.sessions",
    "session_id string, user_id string, session_start timestamp, session_end timestamp, duration_sec bigint, n_events bigint, n_page_views bigint, n_searches bigint, n_product_views bigint, "
    f"n_add_to_cart bigint, n_begin_checkout bigint, n_purchases bigint, revenue {MONEY}, converted boolean, device_type string, country string, utm_source string, session_date date",
    "session_date",
)
STOREFRONT_FUNNEL = Table(
    "gold.daily_funnel",
    "device_type string, sessions bigint, users bigint, sessions_product_view bigint, sessions_add_to_cart bigint, sessions_checkout bigint, sessions_purchase bigint, "
    f"revenue {MONEY}, view_to_cart_rate double, cart_to_purchase_rate double, session_conversion_rate double, session_date date",
    "session_date",
)
MARKETPLACE_SESSIONS = Table(
    "gold.marketplace_sessions",
    "session_id string, user_id string, session_start timestamp, session_end timestamp, duration_sec bigint, n_events bigint, n_views bigint, n_carts bigint, n_removes bigint, n_purchases bigint, "
    f"n_products bigint, revenue {MONEY}, converted boolean, first_category string, n_source_sessions bigint, session_date date",
    "session_date",
)
MARKETPLACE_FUNNEL = Table(
    "gold.marketplace_daily_funnel",
    f"sessions bigint, users bigint, sessions_view bigint, sessions_cart bigint, sessions_purchase bigint, purchase_without_cart bigint, buyers bigint, revenue {MONEY}, "
    "view_to_cart_rate double, session_conversion_rate double, session_date date",
    "session_date",
)
MARKETPLACE_CATEGORIES = Table("gold.marketplace_category_daily", f"category_l1 string, views bigint, carts bigint, purchases bigint, revenue {MONEY}, users bigint, event_date date", "event_date")

TABLES = {t.name: t for t in list(globals().values()) if isinstance(t, Table)}
