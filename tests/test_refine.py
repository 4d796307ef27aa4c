import datetime as dt
import json

import pytest

from clickstrata.functions.events import category_l1
from clickstrata.operators import checks, marts, sessions
from clickstrata.operators.dedup import keep_first
from clickstrata.operators.refine import MARKETPLACE, STOREFRONT, labelled, rejects, valid_events
from clickstrata.schemas import CORRUPT

NOW = dt.datetime(2019, 11, 1)
GOOD = {"event_id": "a", "event_time": "2019-10-01 00:00:00 UTC", "event_type": "view", "product_id": "1", "category_id": "2053013555631882655", "category_code": "a.b.c", "brand": "x", "price": 1.5, "user_id": "u", "user_session": "s"}


def _bronze(spark, payloads):
    rows = [(p if p is None or isinstance(p, str) else json.dumps(p), "files", "f", dt.datetime(2019, 10, 2, tzinfo=dt.UTC), dt.date(2019, 10, 2)) for p in payloads]
    return spark.createDataFrame(rows, "raw_payload string, source string, source_ref string, ingest_ts timestamp, ingest_date date")


ALL_NULL = "null_event_id,null_user_id,bad_event_ts,bad_event_type"


@pytest.mark.parametrize(
    ("payload", "reasons"),
    [
        (GOOD, ""),
        ('{"event_id":"a","pr', f"malformed_json,{ALL_NULL}"),
        ("null", f"malformed_json,{ALL_NULL}"),
        ('[{"event_id":"z"}]', f"malformed_json,{ALL_NULL}"),
        (None, ALL_NULL),
        ("", ALL_NULL),
        (GOOD | {"price": "abc"}, "malformed_json"),
        ({k: v for k, v in GOOD.items() if k != "user_id"}, "null_user_id"),
        (GOOD | {"event_time": "not-a-timestamp"}, "bad_event_ts"),
        (GOOD | {"event_time": "2014-12-31 23:59:59 UTC"}, "bad_event_ts"),
        (GOOD | {"event_time": "2019-11-03 00:00:00 UTC"}, "bad_event_ts"),
        (GOOD | {"event_time": "2019-11-01 23:00:00 UTC"}, ""),
        (GOOD | {"event_type": "teleport"}, "bad_event_type"),
        (GOOD | {"event_type": None}, "bad_event_type"),
        (GOOD | {"price": -1}, "negative_price"),
        (GOOD | {"price": 0}, ""),
        (GOOD | {"price": None}, ""),
        (GOOD | {"more": 1}, ""),
    ],
)
def test_marketplace_rules(spark, payload, reasons):
    assert labelled(_bronze(spark, [payload]), MARKETPLACE, now=NOW).first().reject_reasons == reasons


def test_storefront_rules(spark):
    good = {"event_id": "a", "event_ts": "2024-01-01T10:00:00.123Z", "user_id": "u", "event_type": "purchase", "quantity": 1, "order_value": 9.99}
    rows = labelled(_bronze(spark, [good, good | {"quantity": 0}, good | {"event_ts": "2019-06-01T00:00:00Z"}, good | {"quantity": 1.5}]), STOREFRONT, now=dt.datetime(2024, 2, 1))
    assert [r.reject_reasons for r in rows.collect()] == ["", "bad_quantity", "bad_event_ts", "malformed_json"]
    assert str(valid_events(rows, STOREFRONT).first().order_value) == "9.99"


def test_valid_and_rejects_partition_the_rows(spark):
    rows = labelled(_bronze(spark, [GOOD, "x", None, GOOD | {"event_type": "cart", "event_id": "b"}]), MARKETPLACE, now=NOW)
    good, bad = valid_events(rows, MARKETPLACE), rejects(rows, MARKETPLACE)
    assert (good.count(), bad.count()) == (2, 2)
    assert good.columns == MARKETPLACE.events.fields and bad.columns == MARKETPLACE.quarantine.fields
    assert CORRUPT not in good.columns
    assert [r.event_type for r in good.orderBy("event_id").collect()] == ["product_view", "add_to_cart"]
    assert good.first().category_id == "2053013555631882655"


def test_category_l1(spark):
    rows = spark.createDataFrame([(None,), ("",), ("a",), ("a.b.c",)], "c string")
    assert [r[0] for r in rows.select(category_l1(rows.c)).collect()] == [None, "", "a", "a"]


def _silver(spark, rows):
    """rows: (event_id, user, 'HH:MM:SS' or full time, type, price)."""
    held = [(i, dt.datetime.fromisoformat(f"2019-10-01 {t}" if len(t) == 8 else t).replace(tzinfo=dt.UTC), k, "p", "1", None, None, None, p, u, "s", None) for i, u, t, k, p in rows]
    return spark.createDataFrame(held, "event_id string, event_ts timestamp, event_type string, product_id string, category_id string, category_code string, category_l1 string, brand string, price double, user_id string, source_session_id string, ingest_ts timestamp").selectExpr("*", "to_date(event_ts) AS event_date")


def test_gap_is_exclusive_and_midnight_is_stitched(spark):
    rows = [("1", "a", "10:00:00", "product_view", 1.0), ("2", "a", "10:30:00", "product_view", 1.0), ("3", "a", "11:00:01", "purchase", 2.5), ("4", "b", "2019-10-01 23:50:00", "product_view", 1.0), ("5", "b", "2019-10-02 00:10:00", "purchase", 3.0)]
    found = {(r.user_id, str(r.session_date)): r for r in sessions.marketplace_sessions(_silver(spark, rows)).orderBy("user_id", "session_start").collect()}
    assert sessions.marketplace_sessions(_silver(spark, rows)).count() == 3
    assert found["b", "2019-10-01"].n_events == 2 and found["b", "2019-10-01"].duration_sec == 1200
    assert str(found["b", "2019-10-01"].revenue) == "3.00"


def test_one_exchange_serves_windows_and_aggregate(spark):
    plan = sessions.numbered(_silver(spark, [("1", "a", "10:00:00", "purchase", 1.0)])).groupBy("user_id", "seq").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_funnel_without_views_has_no_rate(spark):
    day = marts.marketplace_funnel(sessions.marketplace_sessions(_silver(spark, [("1", "a", "10:00:00", "purchase", 1.0)]))).first()
    assert (day.purchase_without_cart, day.view_to_cart_rate, day.session_conversion_rate) == (1, None, 1.0)


def test_larger_gap_never_makes_more_sessions(spark):
    rows = [(str(i), f"u{i % 5}", f"{(i * 7) % 24:02d}:{(i * 13) % 60:02d}:00", "product_view", 1.0) for i in range(200)]
    events = _silver(spark, rows)
    counts = [sessions.marketplace_sessions(events, g).count() for g in (60, 1800, 7200, 86_400)]
    assert counts == sorted(counts, reverse=True)
    assert sessions.marketplace_sessions(events, 1800).agg({"n_events": "sum"}).first()[0] == 200


def test_keep_first_is_idempotent(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 5, "q")], "event_id string, ingest_ts int, v string")
    once = keep_first(rows)
    assert sorted(map(tuple, once.collect())) == [("a", 1, "y"), ("b", 5, "q")]
    assert sorted(map(tuple, keep_first(once.unionByName(rows)).collect())) == sorted(map(tuple, once.collect()))


def test_gate_fails_on_hard_checks_only(spark, capsys):
    events = _silver(spark, [("1", "a", "10:00:00", "purchase", 1.0), ("1", "a", "10:00:00", "purchase", 1.0)])
    assert checks.gate(checks.silver_checks(events, 1)) == 1
    assert "FAIL unique_event_id" in capsys.readouterr().out
    one = events.limit(1)
    day = marts.marketplace_funnel(sessions.marketplace_sessions(one))
    assert checks.gate(checks.gold_checks(one, marts.category_daily(one), day)) == 0
    assert "WARN cart_coverage" in capsys.readouterr().out
    assert checks.gate(checks.gold_checks(one, marts.category_daily(one).limit(0), day)) == 1
