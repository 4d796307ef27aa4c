"""The engine's registered queries over the events table, and SQL that says the same.

The table is brought into both event families as JSON payloads with known faults: truncated records, bad times, missing
users, negative prices, unknown types and copies that arrive an hour later. Results show times and days as text and
money as double, so that any engine can compare them.
"""

from __future__ import annotations

import datetime as dt
import tempfile
import uuid
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickstrata import schemas
from clickstrata.functions.events import money
from clickstrata.operators import checks, marts, sessions
from clickstrata.operators.dedup import keep_first, new_rows
from clickstrata.operators.refine import MARKETPLACE, STOREFRONT, Profile, labelled, rejects, valid_events
from clickstrata.plans import batch, flow, replay, sqlbook, synth
from clickstrata.plans.serving import Serving, publish
from clickstrata.session import Lake, configure, shared_folder
from clickstrata.sources import sinks, streams
from clickstrata.streaming import app

INGESTED, NOW = "2024-02-01 00:00:00", dt.datetime(2024, 2, 10)
LOW, HIGH = dt.date(2024, 1, 5), dt.date(2024, 1, 20)
DAY = dt.date(2024, 1, 10)


def shown(df: DataFrame) -> DataFrame:
    """Times and dates as text, money as double."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("u"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def _time() -> F.Column:
    return F.when(F.col("n") % 59 == 3, "not-a-timestamp").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))


def _user() -> F.Column:
    return F.when(F.col("n") % 50 != 1, F.concat(F.lit("u"), F.col("u")))


def _price() -> F.Column:
    return F.when(F.col("n") % 53 == 2, -F.col("value")).otherwise(F.col("value"))


def _named(expr: str, prefix: str) -> F.Column:
    return F.concat(F.lit(prefix), F.expr(expr).cast("string"))


#: Bronze tables that were written, by application, table folder and profile.
_WRITTEN: dict[tuple[str, str, str], str] = {}


def bronze(spark: SparkSession, sf_dir: str, profile: Profile = MARKETPLACE) -> DataFrame:
    """The envelope rows as a table of the shared folder, written once for an application: queries begin at bronze."""
    configure(spark)
    key = spark.sparkContext.applicationId, sf_dir, profile.name
    if key not in _WRITTEN:
        path = shared_folder(spark)
        envelopes(spark, sf_dir, profile).write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def envelopes(spark: SparkSession, sf_dir: str, profile: Profile = MARKETPLACE) -> DataFrame:
    """Envelope rows of the events table, copies included."""
    kind = F.col("event_type")
    if profile is MARKETPLACE:
        fields = {
            "event_id": _named("n", "e"), "event_time": _time(), "event_type": F.when(kind == "click", "cart").when(kind == "signup", "remove_from_cart").otherwise(kind), "product_id": _named("k", "p"),
            "category_id": F.expr("1000000000000000000 + k").cast("string"), "category_code": F.when(F.col("k") % 7 != 0, F.concat(_named("k % 5", "c"), F.lit(".x"))), "brand": _named("k % 3", "b"), "price": _price(),
            "user_id": _user(), "user_session": F.concat(_named("u", "s"), F.lit("-"), F.to_date("ts").cast("string")),
        }
    else:
        fields = {
            "event_id": _named("n", "e"), "event_ts": _time(), "user_id": _user(),
            "event_type": F.when(kind == "view", "product_view").when(kind == "click", "add_to_cart").when(kind == "signup", "begin_checkout").when(kind == "error", "page_view").otherwise(kind),
            "product_id": _named("k", "p"), "price": _price(), "quantity": F.when(F.col("n") % 41 == 5, 0).otherwise((1 + F.col("k") % 3).cast("int")), "order_value": F.when(kind == "purchase", F.col("value")),
            "device_type": F.element_at(F.array(F.lit("mobile"), F.lit("desktop"), F.lit("tablet")), (F.col("u") % 3 + 1).cast("int")), "country": _named("u % 5", "c"), "utm_source": F.when(F.col("u") % 4 != 0, _named("u % 4", "s")),
        }
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    rows = _events(spark, sf_dir).withColumn("raw_payload", F.when(F.col("n") % 61 == 4, F.substring(payload, 1, 18)).otherwise(payload))
    at = F.lit(INGESTED).cast("timestamp")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("n") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(
        "raw_payload", F.lit("events").alias("source"), F.concat_ws("/", F.lit("events"), (F.col("n") % 4).cast("string")).alias("source_ref"), (F.col("n") % 4).cast("int").alias("kafka_partition"), F.col("n").alias("kafka_offset"),
        F.col("ts").alias("source_ts"), (at + F.expr("make_interval(0, 0, 0, 0, copy)")).alias("ingest_ts"), F.to_date(at).alias("ingest_date"),
    )


def _labelled(spark: SparkSession, sf_dir: str, profile: Profile = MARKETPLACE) -> DataFrame:
    return labelled(bronze(spark, sf_dir, profile), profile, now=NOW)


def _valid(spark: SparkSession, sf_dir: str, profile: Profile = MARKETPLACE) -> DataFrame:
    return valid_events(_labelled(spark, sf_dir, profile), profile)


def _silver(spark: SparkSession, sf_dir: str, profile: Profile = MARKETPLACE) -> DataFrame:
    return keep_first(_valid(spark, sf_dir, profile))


def _sessions(spark: SparkSession, sf_dir: str, gap: int = 21_600) -> DataFrame:
    return sessions.marketplace_sessions(_silver(spark, sf_dir), gap)


def _storefront_sessions(spark: SparkSession, sf_dir: str, gap: int = 21_600) -> DataFrame:
    return sessions.storefront_sessions(_silver(spark, sf_dir, STOREFRONT), gap)


def bronze_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bronze(spark, sf_dir)
    return shown(rows.select(F.col("kafka_offset"), "kafka_partition", "source", "source_ref", "source_ts", "ingest_ts", "ingest_date", F.get_json_object("raw_payload", "$.event_id").alias("event_id"), F.get_json_object("raw_payload", "$.price").cast("double").alias("price")))


def parse_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_valid(spark, sf_dir))


def parse_valid_storefront(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_valid(spark, sf_dir, STOREFRONT).select("event_id", "event_ts", "user_id", "event_type", "product_id", "price", "quantity", "order_value", "device_type", "country", "utm_source", "event_date"))


def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(rejects(_labelled(spark, sf_dir), MARKETPLACE).select("source_ref", "ingest_ts", "reject_reasons", "ingest_date"))


def reject_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.reject_breakdown(rejects(_labelled(spark, sf_dir), MARKETPLACE)))


def reject_breakdown_storefront(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.reject_breakdown(rejects(_labelled(spark, sf_dir, STOREFRONT), STOREFRONT)))


def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_silver(spark, sf_dir).select("event_id", "event_ts", "user_id", "price", "ingest_ts"))


def new_events_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    silver = _silver(spark, sf_dir)
    return shown(new_rows(silver, silver.where(F.col("event_date") < F.lit(DAY))).select("event_id", "event_date"))


def sessions_1800(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_sessions(spark, sf_dir, 1800))


def sessions_21600(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_sessions(spark, sf_dir))


def sessions_day_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that start in a range of days, stitched over midnight."""
    return shown(sessions.starting_in(sessions.marketplace_sessions(sessions.event_window(_silver(spark, sf_dir), LOW, HIGH), 1800), LOW, HIGH).select("session_id", "user_id", "session_start", "n_events"))


def storefront_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_storefront_sessions(spark, sf_dir))


def daily_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.marketplace_funnel(_sessions(spark, sf_dir)))


def daily_funnel_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.storefront_funnel(_storefront_sessions(spark, sf_dir)))


def funnel_over_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"funnel_{uuid.uuid4().hex}"
    marts.storefront_funnel(_storefront_sessions(spark, sf_dir)).createOrReplaceTempView(name)
    return shown(sqlbook.run(spark, "funnel_over_devices", funnel=name))


def category_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.category_daily(_silver(spark, sf_dir)))


def session_agreement_ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.agreement_ours(_sessions(spark, sf_dir))


def session_agreement_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.agreement_source(_silver(spark, sf_dir), 21_600)


def channel_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.channel_performance(_storefront_sessions(spark, sf_dir)))


def top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.top_products(_silver(spark, sf_dir))


def top_products_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"events_{uuid.uuid4().hex}"
    _silver(spark, sf_dir, STOREFRONT).createOrReplaceTempView(name)
    return sqlbook.run(spark, "top_products", low=str(LOW), high=str(HIGH), events=name)


def session_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.session_percentiles(_sessions(spark, sf_dir), "session_date"))


def live_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(marts.live_minute(_silver(spark, sf_dir)))


def dq_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.silver_checks(_valid(spark, sf_dir))


def dq_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _silver(spark, sf_dir)
    day = lambda df, c: df.where(F.col(c) == F.lit(DAY))
    return checks.gold_checks(day(events, "event_date"), day(marts.category_daily(events), "event_date"), day(marts.marketplace_funnel(sessions.marketplace_sessions(events)), "session_date"))


def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of replayed rows: a hash of the values and the number of equal rows before."""
    rows = _events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd HH").alias("event_time"), "event_type", _named("k % 4", "p").alias("product_id"), F.col("u").cast("string").alias("user_id"))
    return replay.with_event_ids(rows)


def replay_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload fields after the round trip through JSON; prices that are no numbers stay text."""
    rows = _events(spark, sf_dir).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_type", _named("k", "p").alias("product_id"), F.when(F.col("k") % 7 == 0, "").otherwise("c").alias("category_code"),
        F.when(F.col("n") % 13 == 0, "n/a").otherwise(F.col("k").cast("string")).alias("price"), F.col("u").cast("string").alias("user_id"), F.col("n").cast("string").alias("user_session"),
    )
    held = replay.payloads(replay.with_event_ids(rows))
    field = lambda name: F.get_json_object("payload", f"$.{name}").alias(name)
    return held.select("user_id", "event_time", field("user_session"), field("category_code"), field("product_id"), F.get_json_object("payload", "$.price").try_cast("double").alias("price"), F.col("payload").contains('"price":"').alias("text_price"))


def _lake_with_bronze(spark: SparkSession, sf_dir: str, profile: Profile = MARKETPLACE) -> Lake:
    lake = Lake(shared_folder(spark))
    sinks.overwrite_partitions(bronze(spark, sf_dir, profile), lake.table(profile.raw.name), profile.raw)
    return lake


def partition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver by day after the same bronze days were taken in twice."""
    lake = _lake_with_bronze(spark, sf_dir)
    for _ in range(2):
        batch.refresh_silver(spark, lake, MARKETPLACE, everything=True, now=NOW)
    return _silver_days(spark, lake)


def quarantine_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions left after a range is built again with fewer rows: those that became empty are gone."""
    table, path = schemas.MARKETPLACE_CATEGORIES, shared_folder(spark)
    made = marts.category_daily(_silver(spark, sf_dir))
    days = batch.days_between(LOW, HIGH)
    for held in (made.where(F.col("event_date").isin(days)), made.where((F.col("event_date") >= F.lit(DAY)) & F.col("event_date").isin(days))):
        sinks.overwrite_partitions(held, path, table, days)
    return shown(sinks.read(spark, path, table).groupBy("event_date").agg(F.count("*").alias("categories"), F.sum("views").alias("views")))


def gold_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel as the gold build stores it for a range of days."""
    lake = _lake_with_bronze(spark, sf_dir)
    batch.refresh_silver(spark, lake, MARKETPLACE, everything=True, now=NOW)
    return shown(batch.build_gold(spark, lake, MARKETPLACE, LOW, HIGH)["funnel"])


def _streamed(spark: SparkSession, sf_dir: str, serving: Serving | None = None) -> Lake:
    """All three streams, drained over payload files in event order, several micro-batches."""
    lake = Lake(shared_folder(spark))
    rows = bronze(spark, sf_dir).withColumn("part", F.date_format("source_ts", "yyyyMMdd")).orderBy("part", "kafka_offset", "ingest_ts")
    days = [r[0] for r in rows.select("part").distinct().orderBy("part").collect()]  # one row for each day
    rows.repartition(len(days), "part").select("part", "raw_payload").write.partitionBy("part").text(f"{lake.root}/landing")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        app.run_app(spark, lake, MARKETPLACE, streams.TextSource(lake.landing, 8), app.Options(0, 0, "60 days", max_files_per_trigger=40), serving)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return lake


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _streamed(spark, sf_dir)
    return shown(sinks.read(spark, lake.table(schemas.MARKETPLACE_EVENTS.name), schemas.MARKETPLACE_EVENTS).select("event_id", "event_ts", "event_type", "user_id", "price", "category_l1"))


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lake = _streamed(spark, sf_dir)
    return sinks.read(spark, lake.table(schemas.MARKETPLACE_QUARANTINE.name), schemas.MARKETPLACE_QUARANTINE).groupBy("reject_reasons").agg(F.count("*").alias("rejects"))


def offered(spark: SparkSession, sf_dir: str, store: Serving) -> None:
    """Offer the live minutes of every day to the store, a day's minutes as a batch of its own, each batch twice."""
    minutes = marts.live_minute(_silver(spark, sf_dir)).orderBy("minute", "event_type").toLocalIterator()  # a part at a time
    for batch_id, (_, held) in enumerate(groupby(minutes, lambda r: r["minute"].date())):
        rows = [r.asDict() for r in held]  # one day's minutes
        for _ in range(2):
            store.apply_live("events", batch_id, rows, rows[-1]["minute"], len(rows))


def live_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live minutes in the store after every day's batch was offered twice."""
    with tempfile.TemporaryDirectory() as folder:
        store = Serving.sqlite(f"{folder}/serving.db")
        offered(spark, sf_dir, store)
        return _live_minutes(spark, store)


def _live_minutes(spark: SparkSession, store: Serving) -> DataFrame:
    found = [(m, t, n, c / 100) for m, t, n, c in store.query("SELECT minute, event_type, events, revenue_cents FROM live_minute")]
    return spark.createDataFrame(found, "minute string, event_type string, events bigint, revenue double")


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store says about the latest event after every day's batch, and the batches it has counted."""
    with tempfile.TemporaryDirectory() as folder:
        store = Serving.sqlite(f"{folder}/serving.db")
        offered(spark, sf_dir, store)
        return spark.createDataFrame([(store.status()[0].strftime("%Y-%m-%d %H:%M:%S"), store.query("SELECT count(*) FROM live_batches")[0][0])], "max_event_ts string, batches bigint")


def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live minutes that the silver stream adds up, batch by batch."""
    with tempfile.TemporaryDirectory() as folder:
        store = Serving.sqlite(f"{folder}/serving.db")
        _streamed(spark, sf_dir, store)
        return _live_minutes(spark, store)


def kafka_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the connector's shape as bronze rows."""
    records = bronze(spark, sf_dir).select(
        F.lit(None).cast("binary").alias("key"), F.col("raw_payload").cast("binary").alias("value"), F.lit("events").alias("topic"), F.col("kafka_partition").alias("partition"), F.col("kafka_offset").alias("offset"),
        F.col("source_ts").alias("timestamp"), F.lit(0).alias("timestampType"),
    )
    rows = streams.stamped(streams.kafka_envelope(records), INGESTED)
    return shown(rows.select("source", "source_ref", "kafka_partition", "kafka_offset", "source_ts", "ingest_ts", "ingest_date", F.get_json_object("raw_payload", "$.event_id").alias("event_id")))


def _landed(spark: SparkSession, sf_dir: str) -> Lake:
    """Payloads as gzipped files below the days of their events."""
    lake = Lake(shared_folder(spark))
    sinks.land(bronze(spark, sf_dir).select(F.col("raw_payload").alias("payload"), F.to_date("source_ts").alias("dt")), lake.landing)
    return lake


def _by_file(rows: DataFrame) -> DataFrame:
    held = rows.groupBy(F.regexp_extract("source_ref", "/dt=([0-9-]+)/[^/]*[.]gz$", 1).alias("day"))
    return held.agg(F.count("*").alias("rows"), F.count_if((F.col("source") == "files") & F.col("kafka_partition").isNull() & F.col("kafka_offset").isNull() & F.col("source_ts").isNull()).alias("of_files"))


def file_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files read back as envelopes, by the day in the path each row came from."""
    return _by_file(streams.TextSource(_landed(spark, sf_dir).landing).batch(spark))


def bronze_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze after the files were drained twice by the exactly-once file sink."""
    lake = _landed(spark, sf_dir)
    for _ in range(2):
        app.run_control(spark, [app.bronze_files(spark, lake, MARKETPLACE, streams.TextSource(lake.landing, 8))])
    return _by_file(sinks.read(spark, lake.table(MARKETPLACE.raw.name), MARKETPLACE.raw))


def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed rows of a CSV export by type, and its broken lines."""
    path = shared_folder(spark)
    header = spark.createDataFrame([(",".join(schemas.MARKETPLACE_CSV.fieldNames()),)], "value string")
    fields = [F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type"), _named("k", "p"), F.lit("1"), F.when(F.col("k") % 3 == 0, '"a,b"').otherwise(""), F.lit("brand"), F.col("k").cast("string"), F.col("u").cast("string"), F.lit("s")]
    lines = _events(spark, sf_dir).select(F.when(F.col("n") % 101 == 0, F.lit("torn,line")).otherwise(F.concat_ws(",", *fields)).alias("value"))
    header.unionByName(lines).coalesce(1).write.text(path)
    rows, broken = streams.csv_events(spark, path)
    good = rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.count_if(F.col("category_code") == "a,b").alias("quoted"), F.sum(F.col("price").try_cast("bigint")).alias("price"))
    return good.unionByName(broken.agg(F.lit("broken").alias("event_type"), F.count("*").alias("rows"), F.lit(0).cast("bigint").alias("quoted"), F.lit(None).cast("bigint").alias("price")))


def _silver_lake(spark: SparkSession, sf_dir: str, profile: Profile = MARKETPLACE) -> Lake:
    lake = _lake_with_bronze(spark, sf_dir, profile)
    batch.refresh_silver(spark, lake, profile, everything=True, now=NOW)
    return lake


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver by day through the catalog: external tables whose partitions were written by path."""
    lake, prefix = _silver_lake(spark, sf_dir), f"q{uuid.uuid4().hex}_"
    batch.register(spark, lake, prefix)
    try:
        days = spark.table(f"{prefix}{schemas.MARKETPLACE_EVENTS.name}").groupBy(F.col("event_date").cast("string").alias("event_date")).agg(F.count("*").alias("events"))
        return spark.createDataFrame(days.collect(), days.schema)  # one row a day, before the tables go
    finally:
        batch.unregister(spark, prefix)


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SHOW TABLES lists, and the format and partition column that DESCRIBE gives."""
    lake, prefix = Lake(shared_folder(spark)), f"q{uuid.uuid4().hex}_"
    batch.register(spark, lake, prefix)
    found = []
    try:
        for layer in ("bronze", "silver", "gold"):
            # the session's temporary views are listed in each database
            for r in spark.sql(f"SHOW TABLES IN {prefix}{layer}").where("NOT isTemporary").collect():
                said = {x.col_name: x.data_type for x in spark.sql(f"DESCRIBE FORMATTED {prefix}{layer}.{r.tableName}").collect()}
                found.append((f"{layer}.{r.tableName}", said["Provider"].lower(), said["Type"]))
    finally:
        batch.unregister(spark, prefix)
    return spark.createDataFrame(found, "name string, provider string, type string")


def silver_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver by day after an older bronze day came in late, whose copies of every eleventh event lie two days earlier."""
    lake = _silver_lake(spark, sf_dir)
    before = dt.date.fromisoformat(INGESTED[:10]) - dt.timedelta(days=1)
    field = F.regexp_extract("raw_payload", '"event_time":"([0-9: -]+) UTC"', 1)
    earlier = F.date_format(field.try_cast("timestamp") - F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd HH:mm:ss")
    rows = bronze(spark, sf_dir).where((F.col("kafka_offset") % 11 == 0) & (field != "")).withColumn("raw_payload", F.replace(F.col("raw_payload"), field, earlier))
    sinks.overwrite_partitions(rows.withColumns({"ingest_ts": F.lit(before).cast("timestamp"), "ingest_date": F.lit(before)}), lake.table(MARKETPLACE.raw.name), MARKETPLACE.raw)
    batch.refresh_silver(spark, lake, MARKETPLACE, before, before, now=NOW)
    return _silver_days(spark, lake)


def _silver_days(spark: SparkSession, lake: Lake) -> DataFrame:
    events = sinks.read(spark, lake.table(schemas.MARKETPLACE_EVENTS.name), schemas.MARKETPLACE_EVENTS)
    return shown(events.groupBy("event_date").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"), F.sum("price").cast(schemas.MONEY).alias("price")))


def gold_storefront(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The storefront's funnel as the gold build stores it for a range of days."""
    return shown(batch.build_gold(spark, _silver_lake(spark, sf_dir, STOREFRONT), STOREFRONT, LOW, HIGH)["funnel"])


def gate_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the gate prints for silver with its copies, and whether it fails."""
    found = checks.verdict(checks.silver_checks(_valid(spark, sf_dir)))
    return spark.createDataFrame([(line, found.failed) for line in found.lines], "line string, failed boolean")


def _flown(spark: SparkSession, run: flow.Run, store: Serving) -> DataFrame:
    published = store.query("SELECT session_date, sessions, revenue_cents FROM daily_funnel")
    assert len(published) == 1, published
    day, n, money_cents = published[0]
    return spark.createDataFrame([(task, state, day, n, money_cents / 100) for task, state in run.states.items()], "task string, state string, day string, sessions bigint, revenue double")


def daily_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily run's tasks and what it published."""
    lake = _silver_lake(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        store = Serving.sqlite(f"{folder}/serving.db")
        return _flown(spark, flow.execute(flow.daily(spark, lake, store, DAY, min_rows=1), spark=spark), store)


def refresh_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refresh of the day of the latest live event, and what it published."""
    lake = _silver_lake(spark, sf_dir)
    with tempfile.TemporaryDirectory() as folder:
        store = Serving.sqlite(f"{folder}/serving.db")
        store.apply_live("events", 0, [], dt.datetime.combine(DAY, dt.time(12)), 1)
        return _flown(spark, flow.execute(flow.refresh(spark, lake, store), spark=spark), store)


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver of a stream to which every tenth event comes after the watermark has moved: those within a day of it stay."""
    lake = Lake(shared_folder(spark))
    rows = bronze(spark, sf_dir).where(F.col("ingest_ts") == F.lit(INGESTED).cast("timestamp")).withColumn("late", F.col("kafka_offset") % 10 == 0)
    last = rows.agg(F.max("source_ts")).first()[0].date()
    on_last = F.to_date("source_ts") == F.lit(last)
    options = app.Options(0, 0, max_files_per_trigger=1000)
    # in time; the last day, which moves the watermark; late
    for k, part in enumerate((rows.where(~F.col("late") & ~on_last), rows.where(on_last), rows.where(F.col("late") & ~on_last))):
        part.select("raw_payload").coalesce(1).write.text(f"{lake.landing}/{k}")
        app.run_app(spark, lake, MARKETPLACE, streams.TextSource(lake.landing, 1000), options)
    return shown(sinks.read(spark, lake.table(schemas.MARKETPLACE_EVENTS.name), schemas.MARKETPLACE_EVENTS).groupBy("event_date").agg(F.count("*").alias("events"), F.count_if(F.expr("cast(substr(event_id, 2) AS bigint) % 10 = 0")).alias("late")))


def replay_paced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paced replay in slices of a day: what each slice sent."""
    rows = _events(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_type", _named("k", "p").alias("product_id"), F.col("k").cast("string").alias("price"), F.col("u").cast("string").alias("user_id"))
    folder, waits = shared_folder(spark), []
    sent = f"{folder}/sent"
    number = iter(range(1 << 30))
    replay.replay_slices(rows, lambda part: part.withColumn("slice", F.lit(next(number))).write.mode("append").parquet(sent), folder, 86_400, 1, clock=lambda: 0.0, sleep=waits.append)
    return spark.read.parquet(sent).groupBy("slice").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users")).withColumn("due", F.col("slice").cast("double"))


def _book(spark: SparkSession, name: str, **views: DataFrame) -> DataFrame:
    """A query of the SQL book over views of these tables, which go when it is analysed: they would be listed in each database."""
    names = {k: f"{k}_{uuid.uuid4().hex}" for k in views}
    for k, df in views.items():
        df.createOrReplaceTempView(names[k])
    try:
        return shown(sqlbook.run(spark, name, **names))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)


def sql_reject_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, "reject_breakdown", quarantine=rejects(_labelled(spark, sf_dir), MARKETPLACE))


def sql_channel_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, "channel_performance", sessions=_storefront_sessions(spark, sf_dir))


def sql_session_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, "session_percentiles", sessions=_storefront_sessions(spark, sf_dir))


def publish_readback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published funnel, read back from the store after two publications of the same range."""
    events = _silver(spark, sf_dir)
    funnel, categories = marts.marketplace_funnel(sessions.marketplace_sessions(events)), marts.category_daily(events)
    with tempfile.TemporaryDirectory() as folder:
        store = Serving.sqlite(f"{folder}/serving.db")
        for _ in range(2):
            publish(store, funnel, categories, LOW, HIGH)
        found = [(d, s, u, c / 100) for d, s, u, c in store.query("SELECT session_date, sessions, users, revenue_cents FROM daily_funnel")]
    return spark.createDataFrame(found, "session_date string, sessions bigint, users bigint, revenue double")


def reconcile_bronze_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).select(F.concat(F.lit("e"), "kafka_offset").alias("event_id"), F.to_date("source_ts").alias("event_date"), "reject_reasons")
    return shown(checks.reconcile(rows, _silver(spark, sf_dir), rows.where("reject_reasons <> ''")))


def money_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(_events(spark, sf_dir).agg(F.sum(money(F.col("value"))).cast(schemas.MONEY).alias("value")))


def synth_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a seeded run for as many users as the events have shows what the generator promises."""
    users = _events(spark, sf_dir).agg(F.count_distinct("u")).first()[0]
    conf = synth.Synth(days=2, events_per_day=20_000, users=users, products=400, shards=4)
    events = synth.events(spark, conf)
    visits = events.groupBy("day", "shard", "session").agg(*[F.max((F.col("event_type") == kind).cast("int")).alias(name) for name, kind in (("saw", "product_view"), ("put", "add_to_cart"), ("paid", "purchase"))])
    of_visits = visits.agg(F.avg("paid").alias("conversion"), (F.sum("put") / F.sum("saw")).alias("view_to_cart")).first()
    share = {r.noise: r.share for r in synth.delivered(events, conf).groupBy("noise").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / (2 * conf.events_per_day)).collect()}
    held = labelled(streams.stamped(synth.generated(spark, conf).select(F.col("payload").alias("raw_payload"))), STOREFRONT, now=dt.datetime(2026, 9, 30))
    rejected = held.agg(F.avg((F.col("reject_reasons") != "").cast("double")), F.count_distinct("user_id")).first()
    near = lambda x, wanted: abs(x - wanted) < 0.25 * wanted
    found = {
        "conversion of 4 to 6 per cent": 0.04 <= of_visits.conversion <= 0.06, "view to cart of about 40 per cent": near(of_visits.view_to_cart, 0.4), "late records": near(share["late"], conf.late_rate),
        "repeated records": near(share["repeated"], 2 * conf.dup_rate), "damaged records": near(share["damaged"], conf.bad_rate), "rejects are the damaged": near(rejected[0], conf.bad_rate), "events a day": near(sum(share.values()), 1.0),
    }
    return spark.createDataFrame([(name, bool(held), users) for name, held in found.items()], "outcome string, met boolean, users bigint")


_FUNCTIONS = (
    bronze_envelope, parse_valid, parse_valid_storefront, quarantine_reasons, reject_breakdown, reject_breakdown_storefront, dedup_keep_first, new_events_only, sessions_1800, sessions_21600, sessions_day_range, storefront_sessions,
    daily_funnel, daily_funnel_by_segment, funnel_over_devices, category_daily, session_agreement_ours, session_agreement_source, channel_performance, top_products, top_products_sql, session_percentiles, live_minute, dq_silver, dq_gold,
    event_ids, replay_payloads, partition_upsert, quarantine_cleared, gold_build, stream_dedup, stream_quarantine, live_ledger, publish_readback, reconcile_bronze_silver, money_total, synth_outcomes,
    freshness, stream_live, kafka_envelope, file_landing, bronze_drain, csv_export, catalog_tables, catalog_listing, silver_backfill, gold_storefront, gate_runner, daily_flow, refresh_flow, late_events, replay_paced,
    sql_reject_breakdown, sql_channel_performance, sql_session_percentiles,
)
QUERIES = {f.__name__: f for f in _FUNCTIONS}

_BASE = """
base AS (SELECT event_id AS n, date_trunc('second', ts) AS ts, user_id AS u, event_type AS t, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
copies AS (SELECT *, 0 AS copy FROM base UNION ALL SELECT *, 1 FROM base WHERE n % 97 = 0),
marked AS (SELECT *, CASE t WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'remove_from_cart' ELSE t END AS src_type, n % 61 = 4 AS torn,
  concat_ws(',', CASE WHEN n % 61 = 4 THEN 'malformed_json,null_event_id' END, CASE WHEN n % 61 = 4 OR n % 50 = 1 THEN 'null_user_id' END, CASE WHEN n % 61 = 4 OR n % 59 = 3 THEN 'bad_event_ts' END,
    CASE WHEN n % 61 = 4 OR t = 'error' THEN 'bad_event_type' END, CASE WHEN n % 61 <> 4 AND n % 53 = 2 AND value > 0 THEN 'negative_price' END) AS reasons,
  TIMESTAMP '2024-02-01 00:00:00' + to_hours(copy) AS ingest_ts FROM copies),
valid AS (SELECT n, 'e' || n AS event_id, ts AS event_ts, CASE src_type WHEN 'view' THEN 'product_view' WHEN 'cart' THEN 'add_to_cart' ELSE src_type END AS event_type, 'p' || k AS product_id,
  CAST(1000000000000000000 + k AS VARCHAR) AS category_id, CASE WHEN k % 7 <> 0 THEN 'c' || (k % 5) || '.x' END AS category_code, CASE WHEN k % 7 <> 0 THEN 'c' || (k % 5) END AS category_l1, 'b' || (k % 3) AS brand,
  CAST(value AS DECIMAL(18,2)) AS price, 'u' || u AS user_id, 's' || u || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS source_session_id, ingest_ts, CAST(ts AS DATE) AS event_date, copy FROM marked WHERE reasons = ''),
silver AS (SELECT * FROM valid WHERE copy = 0)"""
_FRONT = """
fbase AS (SELECT event_id AS n, date_trunc('second', ts) AS ts, user_id AS u, event_type AS t, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
fcopies AS (SELECT *, 0 AS copy FROM fbase UNION ALL SELECT *, 1 FROM fbase WHERE n % 97 = 0),
fmarked AS (SELECT *, CASE WHEN n % 41 = 5 THEN 0 ELSE 1 + k % 3 END AS quantity,
  concat_ws(',', CASE WHEN n % 61 = 4 THEN 'malformed_json,null_event_id' END, CASE WHEN n % 61 = 4 OR n % 50 = 1 THEN 'null_user_id' END, CASE WHEN n % 61 = 4 OR n % 59 = 3 THEN 'bad_event_ts' END,
    CASE WHEN n % 61 = 4 THEN 'bad_event_type' END, CASE WHEN n % 61 <> 4 AND n % 53 = 2 AND value > 0 THEN 'negative_price' END, CASE WHEN n % 61 <> 4 AND n % 41 = 5 THEN 'bad_quantity' END) AS reasons FROM fcopies),
fvalid AS (SELECT 'e' || n AS event_id, ts AS event_ts, 'u' || u AS user_id, CASE t WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'begin_checkout' WHEN 'error' THEN 'page_view' ELSE t END AS event_type,
  'p' || k AS product_id, CAST(value AS DECIMAL(18,2)) AS price, CAST(quantity AS INTEGER) AS quantity, CASE WHEN t = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS order_value,
  ['mobile', 'desktop', 'tablet'][u % 3 + 1] AS device_type, 'c' || (u % 5) AS country, CASE WHEN u % 4 <> 0 THEN 's' || (u % 4) END AS utm_source, CAST(ts AS DATE) AS event_date, copy FROM fmarked WHERE reasons = ''),
fsilver AS (SELECT * FROM fvalid WHERE copy = 0)"""


def _gaps(source: str, gap: int) -> str:
    return f"""
gaps AS (SELECT *, lag(event_ts) OVER w AS before FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY event_ts, event_id)),
numbered AS (SELECT *, sum(CASE WHEN before IS NULL OR floor(epoch(event_ts)) - floor(epoch(before)) > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS seq FROM gaps)"""


def _sessions_sql(gap: int, source: str = "silver") -> str:
    return f"""{_gaps(source, gap)},
sess AS (SELECT md5(user_id || '|' || CAST(min(event_ts) AS VARCHAR)) AS session_id, user_id, min(event_ts) AS session_start, max(event_ts) AS session_end,
  CAST(floor(epoch(max(event_ts))) - floor(epoch(min(event_ts))) AS BIGINT) AS duration_sec, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'product_view') AS n_views,
  count(*) FILTER (WHERE event_type = 'add_to_cart') AS n_carts, count(*) FILTER (WHERE event_type = 'remove_from_cart') AS n_removes, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases,
  count(DISTINCT product_id) AS n_products, CAST(coalesce(sum(price) FILTER (WHERE event_type = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue, count(*) FILTER (WHERE event_type = 'purchase') > 0 AS converted,
  arg_min_null(category_l1, (event_ts, event_id)) AS first_category, count(DISTINCT source_session_id) AS n_source_sessions, CAST(min(event_ts) AS DATE) AS session_date FROM numbered GROUP BY user_id, seq)"""


def _front_sessions_sql(gap: int, source: str = "fsilver") -> str:
    return f"""{_gaps(source, gap)},
fsess AS (SELECT md5(user_id || '|' || CAST(min(event_ts) AS VARCHAR)) AS session_id, user_id, min(event_ts) AS session_start, max(event_ts) AS session_end,
  CAST(floor(epoch(max(event_ts))) - floor(epoch(min(event_ts))) AS BIGINT) AS duration_sec, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'page_view') AS n_page_views,
  count(*) FILTER (WHERE event_type = 'search') AS n_searches, count(*) FILTER (WHERE event_type = 'product_view') AS n_product_views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS n_add_to_cart,
  count(*) FILTER (WHERE event_type = 'begin_checkout') AS n_begin_checkout, count(*) FILTER (WHERE event_type = 'purchase') AS n_purchases, CAST(coalesce(sum(order_value), 0) AS DECIMAL(18,2)) AS revenue,
  count(*) FILTER (WHERE event_type = 'purchase') > 0 AS converted, arg_min_null(device_type, (event_ts, event_id)) AS device_type, arg_min_null(country, (event_ts, event_id)) AS country,
  arg_min_null(utm_source, (event_ts, event_id)) AS utm_source, CAST(min(event_ts) AS DATE) AS session_date FROM numbered GROUP BY user_id, seq)"""


_FRONT_SESSIONS = _front_sessions_sql(21_600)
_FUNNEL = """funnel AS (SELECT session_date, count(*) AS sessions, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE n_views > 0) AS sessions_view, count(*) FILTER (WHERE n_carts > 0) AS sessions_cart,
  count(*) FILTER (WHERE n_purchases > 0) AS sessions_purchase, count(*) FILTER (WHERE n_purchases > 0 AND n_carts = 0) AS purchase_without_cart, count(DISTINCT CASE WHEN n_purchases > 0 THEN user_id END) AS buyers,
  CAST(sum(revenue) AS DECIMAL(18,2)) AS revenue, round(count(*) FILTER (WHERE n_carts > 0) / CAST(nullif(count(*) FILTER (WHERE n_views > 0), 0) AS DOUBLE), 4) AS view_to_cart_rate,
  round(count(*) FILTER (WHERE n_purchases > 0) / CAST(count(*) AS DOUBLE), 4) AS session_conversion_rate FROM sess GROUP BY session_date)"""
_FUNNEL_OUT = "SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date, CAST(revenue AS DOUBLE) AS revenue) FROM funnel"
_FRONT_FUNNEL = """ffunnel AS (SELECT session_date, device_type, count(*) AS sessions, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE n_product_views > 0) AS sessions_product_view,
  count(*) FILTER (WHERE n_add_to_cart > 0) AS sessions_add_to_cart, count(*) FILTER (WHERE n_begin_checkout > 0) AS sessions_checkout, count(*) FILTER (WHERE n_purchases > 0) AS sessions_purchase,
  CAST(sum(revenue) AS DECIMAL(18,2)) AS revenue, round(count(*) FILTER (WHERE n_add_to_cart > 0) / CAST(nullif(count(*) FILTER (WHERE n_product_views > 0), 0) AS DOUBLE), 4) AS view_to_cart_rate,
  round(count(*) FILTER (WHERE n_purchases > 0) / CAST(nullif(count(*) FILTER (WHERE n_add_to_cart > 0), 0) AS DOUBLE), 4) AS cart_to_purchase_rate,
  round(count(*) FILTER (WHERE n_purchases > 0) / CAST(count(*) AS DOUBLE), 4) AS session_conversion_rate FROM fsess GROUP BY session_date, device_type)"""
_CATEGORY = """category AS (SELECT event_date, coalesce(category_l1, 'unknown') AS category_l1, count(*) FILTER (WHERE event_type = 'product_view') AS views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts,
  count(*) FILTER (WHERE event_type = 'purchase') AS purchases, CAST(coalesce(sum(price) FILTER (WHERE event_type = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue, count(DISTINCT user_id) AS users FROM silver GROUP BY 1, 2)"""
_MINUTE = """minutes AS (SELECT date_trunc('minute', event_ts) AS minute, event_type, count(*) AS events, CAST(coalesce(sum(price) FILTER (WHERE event_type = 'purchase'), 0) AS DECIMAL(18,2)) AS revenue FROM silver GROUP BY 1, 2)"""
_SESS_OUT = "SELECT * REPLACE (strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start, strftime(session_end, '%Y-%m-%d %H:%M:%S') AS session_end, CAST(session_date AS VARCHAR) AS session_date, CAST(revenue AS DOUBLE) AS revenue)"
_VALID_OUT = "SELECT event_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, event_type, product_id, category_id, category_code, category_l1, brand, CAST(price AS DOUBLE) AS price, user_id, source_session_id, strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') AS ingest_ts, CAST(event_date AS VARCHAR) AS event_date FROM valid"
_RANGE = f"BETWEEN DATE '{LOW}' AND DATE '{HIGH}'"


def _shares_sql(bucket: str, source: str) -> str:
    return f"SELECT bucket, count(*) AS sessions, round(100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 2) AS share FROM (SELECT {bucket} AS bucket FROM {source}) GROUP BY bucket"


def _checks_sql(stats: str, rows: list[tuple[str, bool, str, str]]) -> str:
    parts = [f"SELECT '{name}' AS \"check\", {str(hard).lower()} AS hard, coalesce({condition}, false) AS passed, CAST({detail} AS VARCHAR) AS detail FROM stats" for name, hard, condition, detail in rows]
    return f"WITH {_BASE}, {stats} " + " UNION ALL ".join(parts)


def _flow_sql(*tasks: str) -> str:
    near = f"near AS (SELECT * FROM silver WHERE event_date BETWEEN DATE '{DAY}' - 1 AND DATE '{DAY}' + 1)"
    rows = ", ".join(f"('{t}')" for t in tasks)
    return f"WITH {_BASE}, {near}, {_sessions_sql(1800, 'near')}, {_FUNNEL} SELECT task, 'success' AS state, '{DAY}' AS day, sessions, CAST(revenue AS DOUBLE) AS revenue FROM funnel, (VALUES {rows}) AS t(task) WHERE funnel.session_date = DATE '{DAY}'"


ORACLE_SQL = {
    "bronze_envelope": f"WITH {_BASE} SELECT n AS kafka_offset, CAST(n % 4 AS INTEGER) AS kafka_partition, 'events' AS source, 'events/' || (n % 4) AS source_ref, strftime(ts, '%Y-%m-%d %H:%M:%S') AS source_ts, "
    "strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') AS ingest_ts, '2024-02-01' AS ingest_date, CASE WHEN torn THEN NULL ELSE 'e' || n END AS event_id, CASE WHEN torn THEN NULL WHEN n % 53 = 2 THEN -value ELSE value END AS price FROM marked",
    "parse_valid": f"WITH {_BASE} {_VALID_OUT}",
    "parse_valid_storefront": f"WITH {_FRONT} SELECT event_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, user_id, event_type, product_id, CAST(price AS DOUBLE) AS price, quantity, CAST(order_value AS DOUBLE) AS order_value, device_type, country, utm_source, CAST(event_date AS VARCHAR) AS event_date FROM fvalid",
    "quarantine_reasons": f"WITH {_BASE} SELECT 'events/' || (n % 4) AS source_ref, strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') AS ingest_ts, reasons AS reject_reasons, '2024-02-01' AS ingest_date FROM marked WHERE reasons <> ''",
    "reject_breakdown": f"WITH {_BASE} SELECT '2024-02-01' AS ingest_date, reasons AS reject_reasons, count(*) AS rejects FROM marked WHERE reasons <> '' GROUP BY reasons",
    "reject_breakdown_storefront": f"WITH {_FRONT} SELECT '2024-02-01' AS ingest_date, reasons AS reject_reasons, count(*) AS rejects FROM fmarked WHERE reasons <> '' GROUP BY reasons",
    "dedup_keep_first": f"WITH {_BASE} SELECT event_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, user_id, CAST(price AS DOUBLE) AS price, strftime(ingest_ts, '%Y-%m-%d %H:%M:%S') AS ingest_ts FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_ts) AS r FROM valid) WHERE r = 1",
    "new_events_only": f"WITH {_BASE} SELECT event_id, CAST(event_date AS VARCHAR) AS event_date FROM silver WHERE event_date >= DATE '{DAY}'",
    "sessions_1800": f"WITH {_BASE}, {_sessions_sql(1800)} {_SESS_OUT} FROM sess",
    "sessions_21600": f"WITH {_BASE}, {_sessions_sql(21_600)} {_SESS_OUT} FROM sess",
    "sessions_day_range": f"WITH {_BASE}, near AS (SELECT * FROM silver WHERE event_date BETWEEN DATE '{LOW}' - 1 AND DATE '{HIGH}' + 1), {_sessions_sql(1800, 'near')} SELECT session_id, user_id, strftime(session_start, '%Y-%m-%d %H:%M:%S') AS session_start, n_events FROM sess WHERE session_date {_RANGE}",
    "storefront_sessions": f"WITH {_FRONT}, {_FRONT_SESSIONS} {_SESS_OUT} FROM fsess",
    "daily_funnel": f"WITH {_BASE}, {_sessions_sql(21_600)}, {_FUNNEL} {_FUNNEL_OUT}",
    "daily_funnel_by_segment": f"WITH {_FRONT}, {_FRONT_SESSIONS}, {_FRONT_FUNNEL} SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date, CAST(revenue AS DOUBLE) AS revenue) FROM ffunnel",
    "funnel_over_devices": f"WITH {_FRONT}, {_FRONT_SESSIONS}, {_FRONT_FUNNEL} SELECT CAST(session_date AS VARCHAR) AS session_date, CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(sessions_product_view) AS BIGINT) AS viewed, "
    "CAST(sum(sessions_add_to_cart) AS BIGINT) AS carted, CAST(sum(sessions_checkout) AS BIGINT) AS checkout, CAST(sum(sessions_purchase) AS BIGINT) AS purchased, round(CAST(sum(sessions_purchase) AS DOUBLE) / CAST(sum(sessions) AS DOUBLE), 4) AS conversion, CAST(sum(revenue) AS DOUBLE) AS revenue FROM ffunnel GROUP BY session_date",
    "category_daily": f"WITH {_BASE}, {_CATEGORY} SELECT * REPLACE (CAST(event_date AS VARCHAR) AS event_date, CAST(revenue AS DOUBLE) AS revenue) FROM category",
    "session_agreement_ours": f"WITH {_BASE}, {_sessions_sql(21_600)} " + _shares_sql("CASE WHEN n_source_sessions = 0 THEN 'no source id' WHEN n_source_sessions = 1 THEN 'exactly 1' ELSE 'merges several' END", "sess"),
    "session_agreement_source": f"WITH {_BASE}, {_gaps('silver', 21_600)}, held AS (SELECT source_session_id, count(DISTINCT (user_id, seq)) AS n FROM numbered WHERE source_session_id IS NOT NULL GROUP BY 1) " + _shares_sql("CASE WHEN n = 1 THEN 'kept whole' ELSE 'split' END", "held"),
    "channel_performance": f"WITH {_FRONT}, {_FRONT_SESSIONS} SELECT coalesce(utm_source, 'direct') AS channel, count(*) AS sessions, count(*) FILTER (WHERE converted) AS conversions, CAST(CAST(sum(revenue) AS DECIMAL(18,2)) AS DOUBLE) AS revenue, "
    "round(count(*) FILTER (WHERE converted) / CAST(count(*) AS DOUBLE), 4) AS conversion_rate FROM fsess GROUP BY 1",
    "top_products": f"WITH {_BASE} SELECT product_id, count(*) FILTER (WHERE event_type = 'product_view') AS views, count(*) FILTER (WHERE event_type = 'add_to_cart') AS carts FROM silver GROUP BY product_id ORDER BY views DESC, product_id LIMIT 10",
    "top_products_sql": f"WITH {_FRONT} SELECT product_id, CAST(NULL AS VARCHAR) AS category, count(*) FILTER (WHERE event_type = 'product_view') AS views, CAST(coalesce(sum(quantity) FILTER (WHERE event_type = 'add_to_cart'), 0) AS BIGINT) AS units_carted FROM fsilver WHERE event_date {_RANGE} GROUP BY product_id ORDER BY views DESC, product_id LIMIT 10",
    "session_percentiles": f"WITH {_BASE}, {_sessions_sql(21_600)} SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS sessions, quantile_disc(duration_sec, 0.5) AS p50_duration_sec, quantile_disc(duration_sec, 0.9) AS p90_duration_sec, round(avg(n_events), 4) AS avg_events FROM sess GROUP BY session_date",
    "live_minute": f"WITH {_BASE}, {_MINUTE} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, event_type, events, CAST(revenue AS DOUBLE) AS revenue FROM minutes",
    "dq_silver": _checks_sql(
        "stats AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids, count(*) FILTER (WHERE user_id IS NULL OR event_ts IS NULL OR event_type IS NULL) AS nulls, count(*) FILTER (WHERE price < 0) AS negative FROM valid)",
        [("min_rows", True, f"n >= {checks.MIN_ROWS}", "n"), ("unique_event_id", True, "ids = n", "n - ids"), ("no_null_keys", True, "nulls = 0", "nulls"), ("no_negative_price", True, "negative = 0", "negative")],
    ),
    "dq_gold": _checks_sql(
        f"{_sessions_sql(1800)}, {_FUNNEL}, {_CATEGORY}, s AS (SELECT count(*) FILTER (WHERE event_type = 'purchase') AS sp, CAST(coalesce(sum(price) FILTER (WHERE event_type = 'purchase'), 0) AS DECIMAL(18,2)) AS sr FROM silver WHERE event_date = DATE '{DAY}'), "
        f"g AS (SELECT coalesce(sum(purchases), 0) AS gp, CAST(coalesce(sum(revenue), 0) AS DECIMAL(18,2)) AS gr FROM category WHERE event_date = DATE '{DAY}'), "
        f"f AS (SELECT count(*) AS f_rows, sum(sessions) AS sessions, sum(sessions_purchase) AS bought, max(session_conversion_rate) AS conversion, sum(purchase_without_cart) AS no_cart FROM funnel WHERE session_date = DATE '{DAY}'), stats AS (SELECT * FROM s, g, f)",
        [
            ("purchases_match", True, "sp = gp", "sp - gp"), ("revenue_match", True, "abs(sr - gr) <= 0.01", "sr - gr"), ("funnel_exists", True, "f_rows > 0", "f_rows"), ("sessions_positive", True, "sessions > 0", "sessions"),
            ("purchase_sessions_bounded", True, "bought <= sessions", "bought"), ("conversion_in_range", True, "conversion BETWEEN 0 AND 1", "conversion"),
            ("cart_coverage", False, "coalesce(1 - no_cart / CAST(nullif(bought, 0) AS DOUBLE), 1.0) >= 0.2", "round(1 - no_cart / CAST(nullif(bought, 0) AS DOUBLE), 4)"),
        ],
    ),
    "event_ids": f"WITH {_BASE}, r AS (SELECT strftime(ts, '%Y-%m-%d %H') AS event_time, t AS event_type, 'p' || (k % 4) AS product_id, CAST(u AS VARCHAR) AS user_id FROM base) SELECT *, substr(sha1(concat_ws(chr(31), event_time, event_type, product_id, user_id)), 1, 20) || '-' || (row_number() OVER (PARTITION BY event_time, event_type, product_id, user_id) - 1) AS event_id FROM r",
    "replay_payloads": f"WITH {_BASE} SELECT CAST(u AS VARCHAR) AS user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS event_time, CAST(n AS VARCHAR) AS user_session, CASE WHEN k % 7 <> 0 THEN 'c' END AS category_code, 'p' || k AS product_id, CASE WHEN n % 13 <> 0 THEN CAST(k AS DOUBLE) END AS price, n % 13 = 0 AS text_price FROM base",
    "partition_upsert": f"WITH {_BASE} SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS events, count(DISTINCT event_id) AS ids, CAST(sum(price) AS DOUBLE) AS price FROM silver GROUP BY event_date",
    "quarantine_cleared": f"WITH {_BASE}, {_CATEGORY} SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS categories, CAST(sum(views) AS BIGINT) AS views FROM category WHERE event_date {_RANGE} AND event_date >= DATE '{DAY}' GROUP BY event_date",
    "gold_build": f"WITH {_BASE}, near AS (SELECT * FROM silver WHERE event_date BETWEEN DATE '{LOW}' - 1 AND DATE '{HIGH}' + 1), {_sessions_sql(1800, 'near')}, {_FUNNEL} {_FUNNEL_OUT} WHERE session_date {_RANGE}".replace("FROM funnel WHERE session_date", "FROM funnel WHERE funnel.session_date"),
    "stream_dedup": f"WITH {_BASE} SELECT event_id, strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS event_ts, event_type, user_id, CAST(price AS DOUBLE) AS price, category_l1 FROM silver",
    "stream_quarantine": f"WITH {_BASE} SELECT reasons AS reject_reasons, count(*) AS rejects FROM marked WHERE reasons <> '' GROUP BY reasons",
    "live_ledger": f"WITH {_BASE}, {_MINUTE} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, event_type, events, CAST(revenue AS DOUBLE) AS revenue FROM minutes",
    "publish_readback": f"WITH {_BASE}, {_sessions_sql(1800)}, {_FUNNEL} SELECT CAST(session_date AS VARCHAR) AS session_date, sessions, users, CAST(revenue AS DOUBLE) AS revenue FROM funnel WHERE funnel.session_date {_RANGE}",
    "reconcile_bronze_silver": f"WITH {_BASE} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, count(DISTINCT n) AS bronze, count(DISTINCT CASE WHEN reasons = '' THEN n END) AS silver, count(DISTINCT CASE WHEN reasons <> '' THEN n END) AS quarantine, 0::BIGINT AS lost FROM marked GROUP BY 1",
    "money_total": "SELECT CAST(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS DOUBLE) AS value FROM events",
    "freshness": f"WITH {_BASE}, {_MINUTE} SELECT strftime(max(minute), '%Y-%m-%d %H:%M:%S') AS max_event_ts, count(DISTINCT CAST(minute AS DATE)) AS batches FROM minutes",
    "stream_live": f"WITH {_BASE}, {_MINUTE} SELECT strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute, event_type, events, CAST(revenue AS DOUBLE) AS revenue FROM minutes",
    "kafka_envelope": f"WITH {_BASE} SELECT 'kafka' AS source, 'events/' || (n % 4) AS source_ref, CAST(n % 4 AS INTEGER) AS kafka_partition, n AS kafka_offset, strftime(ts, '%Y-%m-%d %H:%M:%S') AS source_ts, '{INGESTED}' AS ingest_ts, '{INGESTED[:10]}' AS ingest_date, "
    "CASE WHEN torn THEN NULL ELSE 'e' || n END AS event_id FROM marked",
    "file_landing": f"WITH {_BASE} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, count(*) AS of_files FROM copies GROUP BY 1",
    "bronze_drain": f"WITH {_BASE} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows, count(*) AS of_files FROM copies GROUP BY 1",
    "csv_export": f"WITH {_BASE} SELECT CASE WHEN n % 101 = 0 THEN 'broken' ELSE t END AS event_type, count(*) AS rows, count(*) FILTER (WHERE n % 101 <> 0 AND k % 3 = 0) AS quoted, CAST(sum(CASE WHEN n % 101 <> 0 THEN k END) AS BIGINT) AS price FROM base GROUP BY 1",
    "catalog_tables": f"WITH {_BASE} SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS events FROM silver GROUP BY 1",
    "catalog_listing": "SELECT * FROM (VALUES " + ", ".join(f"('{t.name}', '{t.format}', 'EXTERNAL')" for t in schemas.TABLES.values()) + ") AS t(name, provider, type)",
    "silver_backfill": f"WITH {_BASE}, moved AS (SELECT *, CASE WHEN n % 11 = 0 THEN event_date - INTERVAL 2 DAYS ELSE event_date END AS day FROM silver) SELECT CAST(CAST(day AS DATE) AS VARCHAR) AS event_date, count(*) AS events, count(DISTINCT event_id) AS ids, CAST(sum(price) AS DOUBLE) AS price FROM moved GROUP BY 1",
    "gold_storefront": f"WITH {_FRONT}, near AS (SELECT * FROM fsilver WHERE event_date BETWEEN DATE '{LOW}' - 1 AND DATE '{HIGH}' + 1), {_front_sessions_sql(1800, 'near')}, {_FRONT_FUNNEL} SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date, CAST(revenue AS DOUBLE) AS revenue) FROM ffunnel WHERE ffunnel.session_date {_RANGE}",
    "gate_runner": f"""WITH {_BASE}, stats AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids, count(*) FILTER (WHERE price < 0) AS negative FROM valid),
        lines AS (SELECT n >= {checks.MIN_ROWS} AS ok, 'min_rows: ' || n AS said FROM stats UNION ALL SELECT ids = n, 'unique_event_id: ' || (n - ids) FROM stats UNION ALL SELECT true, 'no_null_keys: 0' FROM stats UNION ALL SELECT negative = 0, 'no_negative_price: ' || negative FROM stats)
        SELECT CASE WHEN ok THEN 'PASS ' ELSE 'FAIL ' END || said AS line, NOT bool_and(ok) OVER () AS failed FROM lines""",
    "daily_flow": _flow_sql("check_silver", "build_gold", "check_gold", "publish"),
    "refresh_flow": _flow_sql("find_day", "build_gold", "publish"),
    "late_events": f"WITH {_BASE}, last AS (SELECT CAST(max(ts) AS DATE) AS day FROM base), mark AS (SELECT max(event_ts) - INTERVAL 24 HOURS AS edge FROM silver WHERE event_date = (SELECT day FROM last)), "
    "held AS (SELECT * FROM silver WHERE n % 10 <> 0 OR event_date = (SELECT day FROM last) OR event_ts > (SELECT edge FROM mark)) SELECT CAST(event_date AS VARCHAR) AS event_date, count(*) AS events, count(*) FILTER (WHERE n % 10 = 0) AS late FROM held GROUP BY 1",
    "replay_paced": f"WITH {_BASE}, sliced AS (SELECT CAST(floor((epoch(ts) - (SELECT epoch(min(ts)) FROM base)) / 86400) AS INTEGER) AS slice, u FROM base) SELECT slice, count(*) AS events, count(DISTINCT u) AS users, CAST(slice AS DOUBLE) AS due FROM sliced GROUP BY slice",
    "sql_reject_breakdown": f"WITH {_BASE} SELECT '2024-02-01' AS ingest_date, reasons AS reject_reasons, count(*) AS rejects FROM marked WHERE reasons <> '' GROUP BY reasons",
    "sql_channel_performance": f"WITH {_FRONT}, {_FRONT_SESSIONS} SELECT coalesce(utm_source, 'direct') AS channel, count(*) AS sessions, round(avg(duration_sec), 1) AS avg_duration_sec, count(*) FILTER (WHERE converted) AS conversions, "
    "round(100 * avg(CASE WHEN converted THEN 1.0 ELSE 0.0 END), 2) AS conversion_pct, CAST(CAST(sum(revenue) AS DECIMAL(18,2)) AS DOUBLE) AS revenue FROM fsess GROUP BY 1",
    "sql_session_percentiles": f"WITH {_FRONT}, {_FRONT_SESSIONS} SELECT coalesce(CAST(session_date AS VARCHAR), 'all') AS day, quantile_disc(duration_sec, 0.5) AS p50_duration_sec, quantile_disc(duration_sec, 0.9) AS p90_duration_sec, quantile_disc(n_events, 0.9) AS p90_events, "
    "round(avg(n_events), 2) AS avg_events FROM fsess GROUP BY GROUPING SETS ((session_date), ())",
    "synth_outcomes": "SELECT outcome, true AS met, (SELECT count(DISTINCT user_id) FROM events) AS users FROM (VALUES ('conversion of 4 to 6 per cent'), ('view to cart of about 40 per cent'), ('late records'), ('repeated records'), ('damaged records'), ('rejects are the damaged'), ('events a day')) AS t(outcome)",
}
