"""Command line: one subcommand for each job."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from clickstrata import schemas
from clickstrata.operators import checks
from clickstrata.operators.refine import PROFILES, Profile
from clickstrata.plans import batch, flow, replay, sqlbook, synth
from clickstrata.plans.serving import Serving, publish
from clickstrata.session import Lake, get_spark
from clickstrata.sources.sinks import KafkaProducer, kafka_options, land, read, to_kafka
from clickstrata.sources.streams import KafkaSource, TextSource, csv_events
from clickstrata.streaming import app

day = dt.date.fromisoformat


def _source(p: argparse.ArgumentParser, topic: str, offsets: int, files: int) -> None:
    p.add_argument("--source", choices=("kafka", "files"), default="kafka")
    p.add_argument("--bootstrap", default="kafka:9092")
    p.add_argument("--topic", default=topic)
    p.add_argument("--landing")
    p.add_argument("--max-offsets-per-trigger", type=int, default=offsets)
    p.add_argument("--max-files-per-trigger", type=int, default=files)
    p.add_argument("--starting-offsets", default="earliest")


def _serving(p: argparse.ArgumentParser) -> None:
    p.add_argument("--serving", default=os.environ.get("SERVING_DB", "serving.db"), help="path of the serving store, where no --pg-host is given")
    for name in ("host", "db", "user", "password"):
        p.add_argument(f"--pg-{name}", default=os.environ.get(f"SERVING_PG_{name.upper()}"))


def _store(a: argparse.Namespace) -> Serving:
    return Serving.postgres(a.pg_host, a.pg_db or "serving", a.pg_user, a.pg_password) if a.pg_host else Serving.sqlite(a.serving)


def _tables(p: argparse.ArgumentParser, *kinds: str) -> None:
    """Names (layer.table) that take the place of the profile's."""
    for kind in kinds:
        p.add_argument(f"--{kind}", dest={"table": "bronze_table"}.get(kind, kind.replace("-", "_")))


def renamed(profile: Profile, a: argparse.Namespace) -> Profile:
    """The profile with the tables that the arguments name."""
    names = {"raw": "bronze_table", "events": "silver_table", "quarantine": "quarantine_table"}
    return replace(profile, **{field: replace(getattr(profile, field), name=found) for field, arg in names.items() if (found := getattr(a, arg, None))})


def _silver(p: argparse.ArgumentParser) -> None:
    p.add_argument("--watermark", default="24 hours")
    p.add_argument("--min-event-date", default="2015-01-01")
    p.add_argument("--silver-max-files-per-trigger", type=int, default=30)
    p.add_argument("--state-partitions", type=int, default=4)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="clickstrata", description=__doc__)
    top.add_argument("--lake", default=os.environ.get("LAKE_ROOT"))
    top.add_argument("--profile", choices=sorted(PROFILES), default="marketplace")
    sub = top.add_subparsers(dest="job", required=True)
    p = sub.add_parser("ingest", help="drain a source into bronze with the exactly-once file sink")
    _source(p, "clickstream.raw", 5_000_000, 200)
    p = sub.add_parser("stream-bronze")
    _source(p, "events.raw", 500_000, 100)
    _tables(p, "table")
    p.add_argument("--trigger-seconds", type=int, default=10)
    p.add_argument("--run-seconds", type=int, default=0)
    p = sub.add_parser("stream-silver")
    _silver(p)
    _tables(p, "bronze-table", "silver-table", "quarantine-table")
    p.add_argument("--trigger-seconds", type=int, default=30)
    p.add_argument("--run-seconds", type=int, default=0)
    p = sub.add_parser("stream", help="bronze, silver, quarantine and live minutes in one application")
    _source(p, "events.raw", 200_000, 100)
    _silver(p)
    _serving(p)
    _tables(p, "bronze-table", "silver-table", "quarantine-table")
    p.add_argument("--bronze-trigger-seconds", type=int, default=10)
    p.add_argument("--silver-trigger-seconds", type=int, default=30)
    p.add_argument("--no-live", action="store_true")
    p.add_argument("--run-seconds", type=int, default=0)
    p = sub.add_parser("silver", help="refresh silver from bronze days")
    p.add_argument("--ingest-from", type=day)
    p.add_argument("--ingest-to", type=day)
    p.add_argument("--all", action="store_true")
    p.add_argument("--lookback-days", type=int, default=batch.LOOKBACK_DAYS, help="days around the arriving ones in which copies of an id are looked for")
    p = sub.add_parser("gold")
    _tables(p, "silver-table")
    p.add_argument("--from-date", type=day, required=True)
    p.add_argument("--to-date", type=day, required=True)
    p.add_argument("--gap-seconds", type=int, default=1800)
    p = sub.add_parser("publish")
    p.add_argument("--from-date", type=day, required=True)
    p.add_argument("--to-date", type=day, required=True)
    _serving(p)
    p = sub.add_parser("check")
    _tables(p, "silver-table")
    p.add_argument("--stage", choices=("silver", "gold"), required=True)
    p.add_argument("--date", type=day, required=True)
    p.add_argument("--min-rows", type=int, default=checks.MIN_ROWS)
    p = sub.add_parser("daily")
    p.add_argument("--from-date", type=day, required=True)
    p.add_argument("--to-date", type=day)
    p.add_argument("--min-rows", type=int, default=checks.MIN_ROWS)
    _serving(p)
    p = sub.add_parser("refresh")
    p.add_argument("--stale-seconds", type=int, default=flow.STALE_SECONDS)
    _serving(p)
    p = sub.add_parser("replay")
    p.add_argument("--file", required=True)
    p.add_argument("--topic", default="events.raw")
    p.add_argument("--bootstrap", default="kafka:9092")
    p.add_argument("--speedup", type=float, default=1000)
    p.add_argument("--max-events", type=int, default=0)
    p.add_argument("--dry-run", action="store_true", help="print the payloads, send nothing")
    p.add_argument("--progress-every", type=int, default=100_000)
    p.add_argument("--out", help="folder for NDJSON files in place of Kafka")
    p.add_argument("--one-by-one", action="store_true", help="send each event at its time from this process, not slices from the executors")
    p.add_argument("--slice-seconds", type=float, default=5)
    p = sub.add_parser("generate")
    p.add_argument("--start-date", type=day, default=synth.Synth.start_date)
    for name in ("days", "events_per_day", "users", "products", "shards", "seed"):
        p.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(synth.Synth, name))
    for name in ("late_rate", "dup_rate", "bad_rate"):
        p.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(synth.Synth, name))
    p.add_argument("--workers", help="number of local workers, or a Spark master")
    p.add_argument("--sink", choices=("files", "kafka"), default="files")
    p.add_argument("--out")
    p.add_argument("--bootstrap", default="kafka:9092")
    p.add_argument("--topic", default="clickstream.raw")
    p = sub.add_parser("sql")
    p.add_argument("name", choices=sorted(sqlbook.QUERIES))
    sub.add_parser("register", help="create databases and tables over the lake")
    p = sub.add_parser("health")
    _serving(p)
    p.add_argument("--service", action="append", default=[], metavar="NAME=HOST:PORT", help="that must listen: broker, metastore, name node, scheduler")
    p.add_argument("--container", action="append", default=[], help="that must run")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    lake = Lake(a.lake) if a.lake else Lake.from_env()
    profile = renamed(PROFILES[a.profile], a)
    workers = getattr(a, "workers", None)
    spark = get_spark(f"clickstrata-{a.job}", f"local[{workers}]" if workers and workers.isdigit() else workers)
    if a.job in ("ingest", "stream-bronze", "stream"):
        source = KafkaSource(a.bootstrap, a.topic, a.max_offsets_per_trigger, a.starting_offsets) if a.source == "kafka" else TextSource(a.landing or lake.landing, a.max_files_per_trigger)
    if a.job == "ingest":
        app.run_control(spark, [app.bronze_files(spark, lake, profile, source)])
    elif a.job == "stream-bronze":
        app.run_control(spark, [app.bronze_query(spark, lake, profile, source, app.Options(bronze_trigger_seconds=a.trigger_seconds))], a.run_seconds)
    elif a.job == "stream-silver":
        o = app.Options(silver_trigger_seconds=a.trigger_seconds, watermark=a.watermark, floor=a.min_event_date, max_files_per_trigger=a.silver_max_files_per_trigger, state_partitions=a.state_partitions)
        app.run_control(spark, [app.silver_query(spark, lake, profile, o), app.quarantine_query(spark, lake, profile, o)], a.run_seconds)
    elif a.job == "stream":
        o = app.Options(a.bronze_trigger_seconds, a.silver_trigger_seconds, a.watermark, a.min_event_date, a.silver_max_files_per_trigger, a.state_partitions, a.run_seconds)
        app.run_app(spark, lake, profile, source, o, None if a.no_live else _store(a))
    elif a.job == "silver":
        print(json.dumps(batch.refresh_silver(spark, lake, profile, a.ingest_from, a.ingest_to, a.all, lookback_days=a.lookback_days)))
    elif a.job == "gold":
        made = batch.build_gold(spark, lake, profile, a.from_date, a.to_date, a.gap_seconds)
        for name in ("funnel", "agreement_ours", "agreement_source"):
            if name in made:
                made[name].orderBy(F.asc(made[name].columns[0])).show(truncate=False)
    elif a.job == "publish":
        print(json.dumps(publish(_store(a), *[read(spark, lake.table(t.name), t) for t in (schemas.MARKETPLACE_FUNNEL, schemas.MARKETPLACE_CATEGORIES)], a.from_date, a.to_date)))
    elif a.job == "check":
        return checks.gate(batch.check_day(spark, lake, a.stage, a.date, a.min_rows, profile))
    elif a.job == "daily":
        runs = flow.catch_up(spark, lake, _store(a), a.from_date, a.to_date or a.from_date, min_rows=a.min_rows)
        print(json.dumps({str(d): r.states for d, r in runs.items()}))
        return int(not all(r.ok for r in runs.values()))
    elif a.job == "refresh":
        run = flow.execute(flow.refresh(spark, lake, _store(a), a.stale_seconds), spark=spark)
        print(json.dumps(run.states))
        return int(not run.ok)
    elif a.job == "replay":
        rows, broken = csv_events(spark, a.file)
        if a.dry_run:
            print(replay.replay(rows, print_payload, 0, a.max_events, broken.count(), 0), file=sys.stderr)
        elif a.out:
            land(replay.limited(replay.with_event_ids(rows), a.max_events).select("payload", F.substring("event_time", 1, 10).alias("dt")), a.out)
        elif a.one_by_one:
            producer = KafkaProducer(a.bootstrap, a.topic)
            print(replay.replay(rows, producer.send, a.speedup, a.max_events, broken.count(), a.progress_every))
            return int(producer.close() > 0)
        elif a.speedup:
            print(replay.replay_slices(rows, lambda part: to_kafka(part, a.bootstrap, a.topic), lake.checkpoint("replay"), a.speedup, a.slice_seconds, a.max_events, broken.count(), report=print))
        else:
            to_kafka(replay.limited(replay.with_event_ids(rows), a.max_events), a.bootstrap, a.topic)
    elif a.job == "generate":
        rows = synth.generated(spark, synth.Synth(**{k: getattr(a, k) for k in synth.Synth.__dataclass_fields__}))
        if a.sink == "files":
            land(rows, a.out or lake.landing)
        else:
            rows.select(F.get_json_object("payload", "$.user_id").alias("key"), F.col("payload").alias("value")).write.format("kafka").options(**kafka_options(a.bootstrap, a.topic)).save()
    elif a.job == "sql":
        batch.register(spark, lake)
        sqlbook.run(spark, a.name).show(100, truncate=False)
    elif a.job == "register":
        batch.register(spark, lake)
    elif a.job == "health":
        found = flow.health(spark, lake, _store(a), dict(x.split("=", 1) for x in a.service), tuple(a.container))
        print(json.dumps(found))
        return int(not all(found.values()))
    return 0


def print_payload(user: str, payload: str) -> None:
    print(payload)


if __name__ == "__main__":
    sys.exit(main())
