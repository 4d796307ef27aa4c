"""Helpers that several corpus operators share: shared tables, let-bindings, neighbours in key order, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, as in tests, one is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="clickstrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths made since the innermost ``scratch`` began.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own part of the shared folder, which can go when the application has ended."""
    path = f"{shared_dir(spark)}/clickstrata-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Shared tables that are made within are removed at the end: what reads them must have been written by then, elsewhere."""
    token = _MADE.set([])
    try:
        yield
    finally:
        paths = _MADE.get()
        _MADE.reset(token)
        to_path = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(to_path(path), True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends there and each row is computed once."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Bound the bytes of a batch that goes to a Python worker, for the session: rows alone do not bound long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def neighbours(keys: DataFrame, order: list[Column], wrap: bool, out: str, value: str) -> DataFrame:
    """keys with a column ``out``: ``value`` of the next row in the order; after the last the first if ``wrap``, else null.

    keys must be narrow (ids, not texts). Rows are dealt by range, each range is ranked on its own, and only one
    row for each range meets in one task, so no task sees the whole table.
    """
    ranged = keys.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    within = Window.partitionBy("__part").orderBy(*order)
    held = ranged.withColumn("__next", F.lead(F.struct(F.col(value).alias("v"))).over(within)).withColumn("__first", F.row_number().over(within) == 1)
    heads = held.where("__first").select("__part", F.struct(F.col(value).alias("v")).alias("__head"))
    by_part = Window.orderBy("__part")
    after = heads.withColumn("__after", F.lead("__head").over(by_part))
    if wrap:
        after = after.withColumn("__after", F.coalesce("__after", F.first("__head").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return held.join(F.broadcast(after.select("__part", "__after")), "__part").withColumn(out, F.coalesce("__next", "__after")["v"]).drop("__part", "__next", "__first", "__after")


def unlike_neighbours(keys: DataFrame, order: list[Column], value: str, kind: str) -> DataFrame:
    """keys with columns ``ahead`` and ``behind``: ``value`` of the next row in the order whose ``kind`` (not null) differs, and
    of the last one before; null where there is none.

    As ``neighbours``: each range on its own, in time that grows with its rows (frames only grow, on either side), then one
    row for each range. Of a range, its first and last row and the first and last row of another kind than those answer
    for whatever runs into it; one that is all of that kind passes the question on.
    """
    ranged = written(keys.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    up = Window.partitionBy("__part").orderBy(*order)
    held = ranged.withColumn("__v", F.struct(F.col(value).alias("v"))).withColumns({
        "__n": F.row_number().over(up), "__up": F.when(F.lead(kind).over(up) != F.col(kind), F.lead("__v").over(up)), "__down": F.when(F.lag(kind).over(up) != F.col(kind), F.lag("__v").over(up)),
    })
    grown = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumn("__behind", F.last("__down", ignorenulls=True).over(grown(up)))
    held = held.withColumn("__ahead", F.last("__up", ignorenulls=True).over(grown(Window.partitionBy("__part").orderBy(F.desc("__n"))))).drop("__up", "__down")
    ends = lambda f: f(F.struct(F.col("__n").alias("n"), F.col("__v").alias("v"), F.col(kind).alias("kind"), F.col("__ahead").alias("ahead"), F.col("__behind").alias("behind")))
    ranges = held.groupBy("__part").agg(ends(F.min).alias("head"), ends(F.max).alias("tail"))
    parts, parts_down = Window.orderBy("__part"), Window.orderBy(F.desc("__part"))
    seen = ranges.withColumns({
        "__up": F.when(F.lead("head.kind").over(parts) != F.col("tail.kind"), F.lead("head.v").over(parts)).otherwise(F.lead("head.ahead").over(parts)),
        "__down": F.when(F.lag("tail.kind").over(parts) != F.col("head.kind"), F.lag("tail.v").over(parts)).otherwise(F.lag("tail.behind").over(parts)),
    })
    seen = seen.select("__part", F.last("__up", ignorenulls=True).over(grown(parts_down)).alias("__after"), F.last("__down", ignorenulls=True).over(grown(parts)).alias("__before"))
    found = held.join(F.broadcast(seen), "__part")  # one row a range
    return found.withColumns({"ahead": F.coalesce("__ahead", "__after")["v"], "behind": F.coalesce("__behind", "__before")["v"]}).drop("__part", "__v", "__n", "__ahead", "__behind", "__after", "__before")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node, root (the least node of its component) for each node of the undirected edges (a, b).

    Alternating large-star and small-star steps, each written to the shared folder. A node's neighbours meet only in
    a partially aggregated minimum and in an equi-join, which Spark splits where one node has very many: it can, since
    the minima are written apart and no aggregate shares the join's exchange.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "large-star-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large-star")
        down = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-star-least")
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "small-star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
