"""A small pipeline runner: ordered tasks with retries, exponential waits, time limits and skips."""

from __future__ import annotations

import concurrent.futures
import datetime as dt
import os
import socket
import subprocess
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from clickstrata.operators import checks
from clickstrata.operators.refine import MARKETPLACE
from clickstrata.plans import batch
from clickstrata.plans.serving import Serving, publish
from clickstrata.session import Lake

STALE_SECONDS = int(os.environ.get("LAKEHOUSE_REFRESH_STALE_SECONDS", "900"))


class Skip(Exception):
    """Raised by a task: the rest of the run is not needed."""


class GateFailed(RuntimeError):
    pass


@dataclass
class Task:
    name: str
    run: Callable[[], object]
    retries: int = 2
    wait_seconds: float = 60
    limit_seconds: float = 3600


@dataclass
class Run:
    states: dict[str, str] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return all(s in ("success", "skipped") for s in self.states.values())


class StillRunning(RuntimeError):
    """A task neither ended in its time nor could be stopped."""


def attempt_once(task: Task, spark: SparkSession | None = None, grace_seconds: float = 60) -> None:
    """Run the task in its time. Beyond it its Spark jobs are cancelled, and it is waited for: two attempts of a task never
    run at once."""
    group = f"{task.name}-{uuid.uuid4().hex}"

    def work() -> None:
        if spark is not None:
            spark.sparkContext.setJobGroup(group, task.name, True)
        task.run()

    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        found = pool.submit(work)
        try:
            found.result(task.limit_seconds)
        except concurrent.futures.TimeoutError:
            if found.done():  # the task's own error
                raise
            end = time.monotonic() + grace_seconds
            while not found.done() and time.monotonic() < end:
                if spark is not None:
                    spark.sparkContext.cancelJobGroup(group)  # again and again: the task may go on to its next job
                concurrent.futures.wait([found], 0.5)
            if not found.done():
                raise StillRunning(task.name) from None
            raise
    finally:
        pool.shutdown(wait=False)


def execute(tasks: list[Task], sleep: Callable[[float], None] = time.sleep, spark: SparkSession | None = None) -> Run:
    """One task after the other; a task that fails for good, or can't be stopped, stops those behind it."""
    run = Run(dict.fromkeys([t.name for t in tasks], "none"))
    for task in tasks:
        for attempt in range(task.retries + 1):
            try:
                attempt_once(task, spark)
                run.states[task.name] = "success"
                break
            except Skip:
                run.states.update({n: "skipped" for n, s in run.states.items() if s == "none"})
                return run
            except StillRunning:
                run.states[task.name] = "failed"
                break
            except Exception:
                run.states[task.name] = "failed"
                if attempt < task.retries:
                    sleep(task.wait_seconds * 2**attempt)
        if run.states[task.name] == "failed":
            run.states.update({n: "upstream_failed" for n, s in run.states.items() if s == "none"})
            return run
    return run


def _gate(results) -> None:
    if checks.gate(results):
        raise GateFailed("a hard check failed")


def daily(spark: SparkSession, lake: Lake, store: Serving, day: dt.date, min_rows: int = checks.MIN_ROWS) -> list[Task]:
    """Check silver, build gold, check gold, publish."""
    made: dict = {}
    return [
        Task("check_silver", lambda: _gate(batch.check_day(spark, lake, "silver", day, min_rows))),
        Task("build_gold", lambda: made.update(batch.build_gold(spark, lake, MARKETPLACE, day, day))),
        Task("check_gold", lambda: _gate(batch.check_day(spark, lake, "gold", day))),
        Task("publish", lambda: publish(store, made["funnel"], made["categories"], day, day)),
    ]


def catch_up(spark: SparkSession, lake: Lake, store: Serving, low: dt.date, high: dt.date, **options) -> dict[dt.date, Run]:
    """The daily flow for each day, one at a time."""
    return {day: execute(daily(spark, lake, store, day, **options), spark=spark) for day in batch.days_between(low, high)}


def refresh(spark: SparkSession, lake: Lake, store: Serving, stale_seconds: int = STALE_SECONDS, now: dt.datetime | None = None) -> list[Task]:
    """Rebuild and publish the day of the latest live event; skipped where there is none or it has not moved lately."""
    found: dict = {}

    def find_day() -> None:
        status = store.status()
        if status is None or ((now or dt.datetime.now(dt.UTC)) - status[1]).total_seconds() > stale_seconds:
            raise Skip
        found["day"] = status[0].date()

    return [
        Task("find_day", find_day),
        Task("build_gold", lambda: found.update(batch.build_gold(spark, lake, MARKETPLACE, found["day"], found["day"]))),
        Task("publish", lambda: publish(store, found["funnel"], found["categories"], found["day"], found["day"])),
    ]


def reachable(address: str, seconds: float = 3) -> bool:
    """Whether something listens at host:port."""
    host, _, port = address.rpartition(":")
    try:
        socket.create_connection((host, int(port)), seconds).close()
        return True
    except (OSError, ValueError):
        return False


def health(spark: SparkSession, lake: Lake, store: Serving, services: dict[str, str] | None = None, containers: tuple[str, ...] = ()) -> dict[str, bool]:
    """Whether Spark computes, the lake is written and read, the catalog and the serving store answer, each of the services
    (name to host:port) listens, and each of the containers runs."""

    def tried(f: Callable[[], object]) -> bool:
        try:
            return f() is not False
        except Exception:
            return False

    def lake_works() -> bool:
        path = lake.checkpoint("health")
        spark.range(1).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path).count() == 1

    def runs(name: str) -> bool:
        return subprocess.run(["docker", "inspect", "-f", "{{.State.Running}}", name], capture_output=True, text=True, timeout=20).stdout.strip() == "true"

    found = {"spark": tried(lambda: spark.range(1).count()), "lake": tried(lake_works), "catalog": tried(lambda: spark.sql("SHOW DATABASES").count()), "serving": tried(lambda: store.query("SELECT 1 FROM live_status"))}
    found |= {name: tried(lambda address=address: reachable(address)) for name, address in (services or {}).items()}
    return found | {f"container {name}": tried(lambda name=name: runs(name)) for name in containers}
