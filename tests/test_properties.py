"""Properties over generated event tables, against plain Python."""

import datetime as dt
from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clickstrata.functions.events import event_hash
from clickstrata.operators.dedup import keep_first
from clickstrata.operators.sessions import marketplace_sessions, numbered
from clickstrata.plans.replay import with_event_ids

FEW = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
BEGIN = dt.datetime(2019, 10, 1, tzinfo=dt.UTC)
EVENTS = st.lists(st.tuples(st.integers(0, 4), st.integers(0, 30_000), st.sampled_from(["product_view", "add_to_cart", "purchase"]), st.integers(0, 500)), min_size=1, max_size=60)
COLUMNS = "event_id string, event_ts timestamp, event_type string, product_id string, category_l1 string, price double, user_id string, source_session_id string"


def _frame(spark, events):
    return spark.createDataFrame([(f"{i:04d}", BEGIN + dt.timedelta(seconds=s), kind, "p", None, cents / 100, f"u{u}", None) for i, (u, s, kind, cents) in enumerate(events)], COLUMNS)


@FEW
@given(EVENTS, st.sampled_from([60, 1800, 7200]))
def test_sessions_equal_plain_python(spark, events, gap):
    expected = defaultdict(list)
    for user in {e[0] for e in events}:
        held = sorted((s, i, kind, cents) for i, (u, s, kind, cents) in enumerate(events) if u == user)
        for n, (s, i, kind, cents) in enumerate(held):
            if n == 0 or s - held[n - 1][0] > gap:
                expected[f"u{user}"].append([])
            expected[f"u{user}"][-1].append((s, kind, cents))
    want = sorted((u, BEGIN + dt.timedelta(seconds=x[0][0]), x[-1][0] - x[0][0], len(x), sum(c for _, k, c in x if k == "purchase")) for u, held in expected.items() for x in held)
    rows = marketplace_sessions(_frame(spark, events), gap).selectExpr("user_id", "unix_timestamp(session_start) AS t", "duration_sec", "n_events", "cast(revenue * 100 AS bigint) AS cents").collect()
    assert sorted((r.user_id, dt.datetime.fromtimestamp(r.t, dt.UTC), r.duration_sec, r.n_events, r.cents) for r in rows) == want


@FEW
@given(EVENTS)
def test_every_event_has_one_session(spark, events):
    rows = numbered(_frame(spark, events)).groupBy("event_id").count().collect()
    assert len(rows) == len(events) and all(r["count"] == 1 for r in rows)


@FEW
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.integers(0, 5), st.text("xyz", max_size=2)), max_size=30))
def test_keep_first_is_unique_and_stable(spark, rows):
    frame = spark.createDataFrame(rows, "event_id string, ingest_ts int, v string")
    once = sorted(map(tuple, keep_first(frame).collect()))
    assert [r[0] for r in once] == sorted({r[0] for r in rows})
    assert once == [min(x for x in rows if x[0] == i) for i in sorted({r[0] for r in rows})]
    assert sorted(map(tuple, keep_first(frame.repartition(3)).collect())) == once


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["", "1", None])), min_size=1, max_size=20))
def test_event_ids_are_unique_whatever_the_order(spark, rows):
    frame = spark.createDataFrame(rows, "x string, y string")
    ids = sorted(r.event_id for r in with_event_ids(frame).collect())
    assert len(set(ids)) == len({(x, y or "") for x, y in rows}) if len(set(rows)) == len(rows) and None not in {y for _, y in rows} else len(ids) == len(rows)
    assert ids == sorted(r.event_id for r in with_event_ids(frame.repartition(4)).collect())
    assert frame.select(event_hash(frame.x, frame.y)).distinct().count() == len({(x, y or "") for x, y in rows})
