"""Every registered engine query against its SQL on the small tables."""

import duckdb
import pytest

from clickstrata import queries

SF = "/root/testdata/sf0.001"


def _rows(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    assert _rows(df.select(*columns).collect()) == _rows(duck.sql(f"SELECT {names} FROM ({queries.ORACLE_SQL[name]})").fetchall())


def test_catalog_listing_leaves_out_temporary_views(spark, duck):
    spark.range(1).createOrReplaceTempView("passing_view")
    try:
        views = lambda: {r.tableName for r in spark.sql("SHOW TABLES").where("isTemporary").collect()}
        before = views()
        queries.sql_reject_breakdown(spark, SF)
        assert views() == before
        assert _rows(queries.catalog_listing(spark, SF).select("name", "provider", "type").collect()) == _rows(duck.sql(queries.ORACLE_SQL["catalog_listing"]).fetchall())
    finally:
        spark.catalog.dropTempView("passing_view")


def test_every_day_passes_the_ledger_once(spark, duck, tmp_path):
    from clickstrata.plans.serving import Serving

    store = Serving.sqlite(f"{tmp_path}/serving.db")
    queries.offered(spark, SF, store)
    expected = duck.sql(queries.ORACLE_SQL["live_minute"]).fetchall()
    days = {r[0][:10] for r in expected}
    assert len(days) > 1 and store.query("SELECT count(*) FROM live_batches") == [(len(days),)]
    assert _rows((m, t, n, c / 100) for m, t, n, c in store.query("SELECT minute, event_type, events, revenue_cents FROM live_minute")) == _rows(expected)


def test_generator_is_deterministic_and_noisy(spark):
    from clickstrata.plans import synth

    conf = synth.Synth(days=2, events_per_day=2000, users=80, products=60, shards=2, bad_rate=0.05)
    one = sorted(map(tuple, synth.generated(spark, conf).collect()))
    assert one == sorted(map(tuple, synth.generated(spark, conf).repartition(7).collect()))
    assert one != sorted(map(tuple, synth.generated(spark, synth.Synth(**conf.__dict__ | {"seed": 1})).collect()))
    noise = {r.noise: r.n for r in synth.delivered(synth.events(spark, conf), conf).groupBy("noise").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert set(noise) == {"none", "late", "repeated", "damaged"}
    carts = synth.events(spark, conf).where("event_type IN ('add_to_cart', 'remove_from_cart', 'product_view')").where("price IS NULL OR category IS NULL").count()
    assert carts == 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
