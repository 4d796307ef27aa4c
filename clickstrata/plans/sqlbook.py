"""Ad-hoc queries over the registered tables, as Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {
    "reject_breakdown": """
        SELECT ingest_date, reject_reasons, count(*) AS rejects FROM {quarantine} GROUP BY ingest_date, reject_reasons ORDER BY 1, 3 DESC""",
    "funnel_over_devices": """
        SELECT session_date, sum(sessions) AS sessions, sum(sessions_product_view) AS viewed, sum(sessions_add_to_cart) AS carted, sum(sessions_checkout) AS checkout, sum(sessions_purchase) AS purchased,
          round(try_divide(sum(sessions_purchase), sum(sessions)), 4) AS conversion, round(sum(revenue), 2) AS revenue FROM {funnel} GROUP BY session_date ORDER BY 1""",
    "top_products": """
        SELECT product_id, category, sum(CASE WHEN event_type = 'product_view' THEN 1 ELSE 0 END) AS views, coalesce(sum(CASE WHEN event_type = 'add_to_cart' THEN quantity END), 0) AS units_carted
        FROM {events} WHERE event_date BETWEEN DATE '{low}' AND DATE '{high}' AND product_id IS NOT NULL GROUP BY product_id, category ORDER BY views DESC, product_id, category LIMIT 10""",
    "channel_performance": """
        SELECT coalesce(utm_source, 'direct') AS channel, count(*) AS sessions, round(avg(duration_sec), 1) AS avg_duration_sec, count_if(converted) AS conversions,
          round(100 * avg(CASE WHEN converted THEN 1.0D ELSE 0.0D END), 2) AS conversion_pct, sum(revenue) AS revenue FROM {sessions} GROUP BY 1 ORDER BY revenue DESC, channel""",
    "session_percentiles": """
        SELECT coalesce(cast(session_date AS string), 'all') AS day, cast(percentile_disc(0.5) WITHIN GROUP (ORDER BY duration_sec) AS bigint) AS p50_duration_sec,
          cast(percentile_disc(0.9) WITHIN GROUP (ORDER BY duration_sec) AS bigint) AS p90_duration_sec, cast(percentile_disc(0.9) WITHIN GROUP (ORDER BY n_events) AS bigint) AS p90_events, round(avg(n_events), 2) AS avg_events FROM {sessions} GROUP BY GROUPING SETS ((session_date), ()) ORDER BY day""",
    "describe_events": "DESCRIBE FORMATTED {events}",
    "databases": "SHOW DATABASES",
    "silver_tables": "SHOW TABLES IN silver",
}
TABLES = {"quarantine": "silver.events_quarantine", "funnel": "gold.daily_funnel", "events": "silver.events", "sessions": "gold.sessions"}


def run(spark: SparkSession, name: str, low: str = "1970-01-01", high: str = "9999-12-31", **tables: str) -> DataFrame:
    """A query of the book; tables can be replaced by names of views."""
    return spark.sql(QUERIES[name].format(low=low, high=high, **TABLES | tables))
