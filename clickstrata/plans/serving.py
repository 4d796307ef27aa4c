"""Serving store: atomic range publishing, a live ledger that counts each micro-batch once, freshness.

The store speaks DB-API through cursors; a dialect says how a database marks parameters, takes the later of two times and
keeps money. SQLite is in the standard library; for Postgres the driver is imported when a store is made.
"""

from __future__ import annotations

import datetime as dt
import sqlite3
from collections.abc import Callable, Iterable
from contextlib import closing
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cents(value) -> int:
    return int((Decimal(value or 0) * 100).to_integral_value())


def amount(value) -> Decimal:
    return Decimal(value or 0).quantize(Decimal("0.01"))


@dataclass(frozen=True)
class Dialect:
    """mark: of a parameter; later: the function that gives the larger of two values; revenue: the money column's name, and
    how a value gets in and out; minute: the name of the live minutes' column; kinds: the columns' types; begin: how a
    transaction that will write begins, if the driver does not see to it."""

    mark: str
    later: str
    revenue: str
    store: Callable
    load: Callable
    minute: str
    kinds: dict[str, str]
    begin: str = ""


SQLITE = Dialect("?", "max", "revenue_cents", cents, lambda x: Decimal(x) / 100, "minute", {"day": "TEXT", "time": "TEXT", "text": "TEXT", "count": "INTEGER", "money": "INTEGER", "rate": "REAL", "now": "CURRENT_TIMESTAMP"}, "BEGIN IMMEDIATE")
POSTGRES = Dialect("%s", "greatest", "revenue", amount, Decimal, "minute_ts", {"day": "date", "time": "timestamptz", "text": "text", "count": "bigint", "money": "numeric(18,2)", "rate": "double precision", "now": "now()"})


def schema(d: Dialect) -> list[str]:
    """DDL of the serving tables."""
    k = d.kinds
    stamp = lambda name: f"{name} {k['time']} NOT NULL DEFAULT {k['now']}"
    counts = lambda *names: ", ".join(f"{n} {k['count']}" for n in names)
    return [
        f"CREATE TABLE IF NOT EXISTS daily_funnel (session_date {k['day']} PRIMARY KEY, {counts('sessions', 'users', 'sessions_view', 'sessions_cart', 'sessions_purchase', 'purchase_without_cart', 'buyers')}, {d.revenue} {k['money']}, view_to_cart_rate {k['rate']}, session_conversion_rate {k['rate']}, {stamp('refreshed_at')})",
        f"CREATE TABLE IF NOT EXISTS category_daily (event_date {k['day']} NOT NULL, category_l1 {k['text']} NOT NULL, {counts('views', 'carts', 'purchases')}, {d.revenue} {k['money']}, {counts('users')}, {stamp('refreshed_at')}, PRIMARY KEY (event_date, category_l1))",
        f"CREATE TABLE IF NOT EXISTS live_minute ({d.minute} {k['time']} NOT NULL, event_type {k['text']} NOT NULL, events {k['count']} NOT NULL DEFAULT 0, {d.revenue} {k['money']} NOT NULL DEFAULT 0, {stamp('refreshed_at')}, PRIMARY KEY ({d.minute}, event_type))",
        f"CREATE TABLE IF NOT EXISTS live_batches (query {k['text']} NOT NULL, batch_id {k['count']} NOT NULL, {stamp('applied_at')}, PRIMARY KEY (query, batch_id))",
        f"CREATE TABLE IF NOT EXISTS live_status (id INTEGER PRIMARY KEY CHECK (id = 1), max_event_ts {k['time']}, rows_in_batch {k['count']}, {stamp('updated_at')})",
    ]


#: Table, date column, and its other columns, for publishing.
PUBLISHED = {
    "daily_funnel": ("session_date", ["sessions", "users", "sessions_view", "sessions_cart", "sessions_purchase", "purchase_without_cart", "buyers", "revenue", "view_to_cart_rate", "session_conversion_rate"]),
    "category_daily": ("event_date", ["category_l1", "views", "carts", "purchases", "revenue", "users"]),
}


#: Columns whose sums are read back after publishing.
COMPARED = {"daily_funnel": ("sessions", "sessions_purchase", "revenue"), "category_daily": ("purchases", "revenue")}


class Serving:
    def __init__(self, connect: Callable[[], object], dialect: Dialect = SQLITE):
        self.connect, self.dialect = connect, dialect

    @classmethod
    def made(cls, connect: Callable[[], object], dialect: Dialect) -> Serving:
        """A store whose tables are there."""
        store = cls(connect, dialect)
        with closing(connect()) as c:
            with closing(c.cursor()) as cursor:
                for ddl in schema(dialect):
                    cursor.execute(ddl)
            c.commit()
        return store

    @classmethod
    def sqlite(cls, path: str) -> Serving:
        return cls.made(lambda: sqlite3.connect(path, timeout=30), SQLITE)

    @classmethod
    def postgres(cls, host: str, db: str, user: str, password: str) -> Serving:
        import psycopg2

        return cls.made(lambda: psycopg2.connect(host=host, dbname=db, user=user, password=password, connect_timeout=5, options="-c timezone=UTC"), POSTGRES)

    def _sql(self, text: str) -> str:
        return text.replace("?", self.dialect.mark)

    def query(self, sql: str, *values) -> list[tuple]:
        with closing(self.connect()) as c, closing(c.cursor()) as cursor:
            cursor.execute(self._sql(sql), values)
            return cursor.fetchall()

    def _transaction(self, work: Callable):
        """work(cursor) in one transaction: kept if it ends, undone if it raises."""
        with closing(self.connect()) as c, closing(c.cursor()) as cursor:
            try:
                if self.dialect.begin:
                    cursor.execute(self.dialect.begin)
                out = work(cursor)
                c.commit()
                return out
            except BaseException:
                c.rollback()
                raise

    def replace_range(self, table: str, rows: Iterable[dict], low: dt.date, high: dt.date) -> None:
        self.replace_ranges([(table, rows)], low, high)

    def replace_ranges(self, tables: list[tuple[str, Iterable[dict]]], low: dt.date, high: dt.date) -> None:
        """Delete the days of the range and insert the rows, all tables in one transaction."""
        d = self.dialect

        def work(cursor) -> None:
            for table, rows in tables:
                day, columns = PUBLISHED[table]
                names = [day, *[d.revenue if x == "revenue" else x for x in columns]]
                cursor.execute(self._sql(f"DELETE FROM {table} WHERE {day} BETWEEN ? AND ?"), (str(low), str(high)))
                cursor.executemany(self._sql(f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' * len(names))})"), [[str(r[day]), *[d.store(r[x]) if x == "revenue" else r[x] for x in columns]] for r in rows])

        self._transaction(work)

    def sums(self, table: str, low: dt.date, high: dt.date) -> dict[str, object]:
        """Rows of the range, and the sums of the columns that are compared."""
        day, names = PUBLISHED[table][0], COMPARED[table]
        found = self.query(f"SELECT count(*), {', '.join(f'coalesce(sum({self.dialect.revenue if n == "revenue" else n}), 0)' for n in names)} FROM {table} WHERE {day} BETWEEN ? AND ?", str(low), str(high))[0]
        return {"rows": found[0]} | {n: self.dialect.load(x) if n == "revenue" else int(x) for n, x in zip(names, found[1:], strict=True)}

    def apply_live(self, query: str, batch_id: int, minutes: Iterable[dict], max_event_ts: dt.datetime | None, rows: int) -> bool:
        """Add a micro-batch's minutes; False, and no change, if that batch was counted before."""
        d = self.dialect

        def work(cursor) -> bool:
            cursor.execute(self._sql("INSERT INTO live_batches (query, batch_id) VALUES (?, ?) ON CONFLICT DO NOTHING"), (query, batch_id))
            if cursor.rowcount == 0:
                return False
            now = dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S")
            for r in minutes:
                cursor.execute(
                    self._sql(
                        f"INSERT INTO live_minute ({d.minute}, event_type, events, {d.revenue}, refreshed_at) VALUES (?, ?, ?, ?, ?) ON CONFLICT ({d.minute}, event_type) DO UPDATE SET "
                        f"events = live_minute.events + excluded.events, {d.revenue} = live_minute.{d.revenue} + excluded.{d.revenue}, refreshed_at = excluded.refreshed_at"
                    ),
                    (r["minute"].strftime("%Y-%m-%d %H:%M:%S"), r["event_type"], r["events"], d.store(r["revenue"]), now),
                )
            later = f"{d.later}(coalesce(live_status.max_event_ts, excluded.max_event_ts), coalesce(excluded.max_event_ts, live_status.max_event_ts))"
            cursor.execute(
                self._sql(f"INSERT INTO live_status (id, max_event_ts, rows_in_batch, updated_at) VALUES (1, ?, ?, ?) ON CONFLICT (id) DO UPDATE SET max_event_ts = {later}, rows_in_batch = excluded.rows_in_batch, updated_at = excluded.updated_at"),
                (max_event_ts.strftime("%Y-%m-%d %H:%M:%S.%f") if max_event_ts else None, rows, now),
            )
            return True

        return self._transaction(work)

    def status(self) -> tuple[dt.datetime, dt.datetime] | None:
        """Latest event time and when it was written."""
        rows = self.query("SELECT max_event_ts, updated_at FROM live_status WHERE id = 1")
        if not rows or not rows[0][0]:
            return None
        event, written = (x if isinstance(x, dt.datetime) else dt.datetime.fromisoformat(x) for x in rows[0])
        return event.replace(tzinfo=None), written.replace(tzinfo=dt.UTC)


class PublishError(RuntimeError):
    """What was read back differs from what was published, or there was nothing to publish."""


def publish(store: Serving, funnel: DataFrame, categories: DataFrame, low: dt.date, high: dt.date) -> dict[str, int]:
    """Replace the range of both marts in one transaction, read the sums back and compare them.

    A mart has one row for each day, or day and category, so the range's rows fit the driver.
    """
    between = lambda df, day: [r.asDict() for r in df.where(F.col(day).between(F.lit(low), F.lit(high))).collect()]
    days, cats = between(funnel, "session_date"), between(categories, "event_date")
    if not days:
        raise PublishError(f"no funnel rows from {low} to {high}")
    store.replace_ranges([("daily_funnel", days), ("category_daily", cats)], low, high)
    for table, rows in (("daily_funnel", days), ("category_daily", cats)):
        wanted = {"rows": len(rows)} | {n: sum((amount(r[n]) for r in rows), Decimal(0)) if n == "revenue" else sum(r[n] for r in rows) for n in COMPARED[table]}
        if (found := store.sums(table, low, high)) != wanted:
            raise PublishError(f"{table}: published {wanted}, read back {found}")
    return {"daily_funnel": len(days), "category_daily": len(cats)}
