"""Streaming layers: bronze ingest, silver with quarantine, live minutes; each query with a checkpoint of its own."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from clickstrata.operators.dedup import within_watermark
from clickstrata.operators.marts import live_minute
from clickstrata.operators.refine import Profile, labelled, rejects, valid_events
from clickstrata.plans.serving import Serving
from clickstrata.session import Lake
from clickstrata.sources.sinks import append_batch, make_folder
from clickstrata.sources.streams import KafkaSource, TextSource, bronze_stream, stamped

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    """trigger seconds 0 drains what is there and stops; state partitions hold for the life of a checkpoint."""

    bronze_trigger_seconds: int = 10
    silver_trigger_seconds: int = 30
    watermark: str = "24 hours"
    floor: str | None = None
    max_files_per_trigger: int = 30
    state_partitions: int = 4
    run_seconds: int = 0


def _triggered(writer: DataStreamWriter, seconds: int) -> DataStreamWriter:
    return writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)


def bronze_query(spark: SparkSession, lake: Lake, profile: Profile, source: KafkaSource | TextSource, options: Options) -> StreamingQuery:
    """Payloads as they come, no parsing; each micro-batch is written once even if it is tried again."""
    path = lake.table(profile.raw.name)
    make_folder(spark, path)
    name = f"bronze_{profile.name}"
    writer = stamped(source.stream(spark)).writeStream.queryName(name).option("checkpointLocation", lake.checkpoint(name))
    return _triggered(writer.foreachBatch(lambda df, i: append_batch(df, path, profile.raw, i, name)), options.bronze_trigger_seconds).start()


def bronze_files(spark: SparkSession, lake: Lake, profile: Profile, source: KafkaSource | TextSource) -> StreamingQuery:
    """The drain variant: Spark's own exactly-once file sink."""
    name = f"bronze_{profile.name}_files"
    writer = stamped(source.stream(spark)).writeStream.format("parquet").queryName(name).partitionBy(profile.raw.partition)
    return writer.option("path", lake.table(profile.raw.name)).option("checkpointLocation", lake.checkpoint(name)).trigger(availableNow=True).start()


def _checked(spark: SparkSession, lake: Lake, profile: Profile, options: Options) -> DataFrame:
    path = lake.table(profile.raw.name)
    make_folder(spark, path)
    return labelled(bronze_stream(spark, path, profile.raw, options.max_files_per_trigger), profile, options.floor)


def silver_stream(rows: DataFrame, profile: Profile, watermark: str) -> DataFrame:
    """Valid events, each id once within the watermark, which junk times cannot move since it stands after the rules."""
    return within_watermark(valid_events(rows, profile), watermark)


def silver_query(spark: SparkSession, lake: Lake, profile: Profile, options: Options, serving: Serving | None = None) -> StreamingQuery:
    """Valid events; with a serving store also the live minutes of each batch, whose failure never stops the stream."""
    path, name = lake.table(profile.events.name), f"silver_{profile.name}"
    checkpoint = lake.checkpoint(name)

    def write(df: DataFrame, batch_id: int) -> None:
        df.persist()
        try:
            n = append_batch(df, path, profile.events, batch_id, name)
            if n and serving is not None:
                try:
                    # a batch spans few minutes and types; the checkpoint names the stream, so a new one counts anew
                    minutes = [r.asDict() for r in live_minute(df).collect()]
                    serving.apply_live(checkpoint, batch_id, minutes, df.agg(F.max("event_ts")).first()[0], n)
                except Exception:
                    log.exception("live minutes of batch %s", batch_id)
        finally:
            df.unpersist()

    writer = silver_stream(_checked(spark, lake, profile, options), profile, options.watermark).writeStream.queryName(name).option("checkpointLocation", checkpoint)
    # a query takes the session's settings as they are when it starts: only its own state is dealt to so many partitions
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", options.state_partitions)
    try:
        return _triggered(writer.foreachBatch(write), options.silver_trigger_seconds).start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def quarantine_query(spark: SparkSession, lake: Lake, profile: Profile, options: Options) -> StreamingQuery:
    path, name = lake.table(profile.quarantine.name), f"quarantine_{profile.name}"
    writer = rejects(_checked(spark, lake, profile, options), profile).writeStream.queryName(name).option("checkpointLocation", lake.checkpoint(name))
    return _triggered(writer.foreachBatch(lambda df, i: append_batch(df, path, profile.quarantine, i, name)), options.silver_trigger_seconds).start()


def run_control(spark: SparkSession, queries: list[StreamingQuery], run_seconds: int = 0) -> None:
    """Wait until all end, one fails, the time is over or the user interrupts; then stop what still runs."""
    end = time.time() + run_seconds if run_seconds else None
    try:
        while any(q.isActive for q in queries) and (end is None or time.time() < end):
            queries[0].awaitTermination(1) if len(queries) == 1 else spark.streams.awaitAnyTermination(1)
            spark.streams.resetTerminated()
    except KeyboardInterrupt:
        pass
    finally:
        for q in queries:
            if q.isActive:
                q.stop()
    for q in queries:
        if q.exception() is not None:
            raise q.exception()


def run_app(spark: SparkSession, lake: Lake, profile: Profile, source: KafkaSource | TextSource, options: Options, serving: Serving | None = None) -> None:
    """Bronze, silver and quarantine in one application; draining runs them one after the other."""
    if options.bronze_trigger_seconds == 0:
        run_control(spark, [bronze_query(spark, lake, profile, source, options)])
        run_control(spark, [silver_query(spark, lake, profile, options, serving), quarantine_query(spark, lake, profile, options)], options.run_seconds)
        return
    run_control(spark, [bronze_query(spark, lake, profile, source, options), silver_query(spark, lake, profile, options, serving), quarantine_query(spark, lake, profile, options)], options.run_seconds)
