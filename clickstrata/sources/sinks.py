"""Sinks: partition overwrite that also clears emptied partitions, idempotent micro-batches, landing files, Kafka."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstrata.schemas import Table


def read(spark: SparkSession, path: str, table: Table) -> DataFrame:
    """A table by path with its declared schema; empty where nothing has been written, and only there."""
    try:
        return spark.read.schema(table.struct).format(table.format).load(path).select(*table.fields)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], table.struct)


def _store(spark: SparkSession, path: str):
    """The file system of a path, whatever store it is, and its path class."""
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark._jsc.hadoopConfiguration()), to_path


def _remove(spark: SparkSession, path: str) -> None:
    fs, to_path = _store(spark, path)
    if fs.exists(to_path(path)):
        fs.delete(to_path(path), True)


def make_folder(spark: SparkSession, path: str) -> None:
    """A folder, so that a stream can watch it before the first write."""
    fs, to_path = _store(spark, path)
    fs.mkdirs(to_path(path))


def overwrite_partitions(df: DataFrame, path: str, table: Table, days: list | None = None) -> list[str]:
    """Replace the partitions in df; with ``days`` also clear those of the days that df has no rows for.

    Rows are computed once, into a staging folder; only then each partition's folder is replaced by renaming. So df may
    read the table itself, and a run that fails before the renames changes nothing. Where a store renames by copying, the
    exchange takes as long as the copies. Gives the names of the replaced partitions.
    """
    spark = df.sparkSession
    staged = f"{path}/_staging/{uuid.uuid4().hex}"
    df.select(*table.fields).write.format(table.format).partitionBy(table.partition).save(staged)
    fs, to_path = _store(spark, path)
    made = [s.getPath().getName() for s in fs.globStatus(to_path(f"{staged}/{table.partition}=*")) or []]
    for name in made:
        target = to_path(f"{path}/{name}")
        if fs.exists(target):
            fs.delete(target, True)
        if not fs.rename(to_path(f"{staged}/{name}"), target):
            raise OSError(f"{staged}/{name} could not be moved")
    for day in days or []:
        if f"{table.partition}={day}" not in made:
            _remove(spark, f"{path}/{table.partition}={day}")
    fs.delete(to_path(staged), True)
    return made


def append_batch(df: DataFrame, path: str, table: Table, batch_id: int, query: str) -> int:
    """Append a micro-batch exactly once: its files carry the query and batch, and a new try first removes those of an
    earlier one. Files are staged and then renamed, so readers never see half of one.

    Returns the number of rows; an empty batch writes nothing. Rows are kept while they are counted and written.
    """
    spark, mark = df.sparkSession, f"b-{query}-{batch_id:012d}"
    rows = df.select(*table.fields).persist()
    try:
        n = rows.count()
        fs, to_path = _store(spark, path)
        for old in fs.globStatus(to_path(f"{path}/{table.partition}=*/{mark}-*")) or []:
            fs.delete(old.getPath(), False)
        if n:
            staged = f"{path}/_staging/{mark}-{uuid.uuid4().hex}"
            rows.write.format(table.format).partitionBy(table.partition).save(staged)
            for file in fs.globStatus(to_path(f"{staged}/{table.partition}=*/part-*")):
                folder = f"{path}/{file.getPath().getParent().getName()}"
                fs.mkdirs(to_path(folder))
                if not fs.rename(file.getPath(), to_path(f"{folder}/{mark}-{file.getPath().getName()}")):
                    raise OSError(f"{file.getPath()} could not be moved")
            fs.delete(to_path(staged), True)
        return n
    finally:
        rows.unpersist()


def compact(spark: SparkSession, path: str, table: Table, day, files: int = 1) -> None:
    """Rewrite one partition as few files."""
    overwrite_partitions(read(spark, path, table).where(F.col(table.partition) == F.lit(day)).repartition(files), path, table)


def land(payloads: DataFrame, path: str) -> None:
    """Payloads (payload, dt: arrival date) as gzipped NDJSON below dt=... folders."""
    payloads.select("payload", "dt").write.mode("append").partitionBy("dt").option("compression", "gzip").text(path)


def kafka_options(bootstrap: str, topic: str) -> dict[str, str]:
    """Options of an idempotent, compressed Kafka sink."""
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic, "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4", "kafka.acks": "all"}


def to_kafka(events: DataFrame, bootstrap: str, topic: str) -> None:
    """Rows (user_id, payload), keyed by user so that each user's order holds."""
    events.select(F.col("user_id").cast("string").alias("key"), F.col("payload").alias("value")).write.format("kafka").options(**kafka_options(bootstrap, topic)).save()


class KafkaProducer:
    """Sends one record after the other through the client library, with the options of ``kafka_options``.

    Without ``producer`` the library is imported when it is needed: the engine itself does without it.
    """

    def __init__(self, bootstrap: str, topic: str, producer=None):
        if producer is None:
            from confluent_kafka import Producer

            producer = Producer({"bootstrap.servers": bootstrap, "enable.idempotence": True, "acks": "all", "compression.type": "lz4", "linger.ms": 20})
        self.producer, self.topic, self.failed = producer, topic, 0

    def _delivered(self, error, _message) -> None:
        self.failed += error is not None

    def send(self, key: str | None, payload: str) -> None:
        """Keyed by user, so that each user's order holds; waits where the client's queue is full."""
        while True:
            try:
                self.producer.produce(self.topic, value=payload.encode(), key=None if key is None else key.encode(), on_delivery=self._delivered)
                break
            except BufferError:
                self.producer.poll(0.5)
        self.producer.poll(0)

    def close(self, seconds: float = 60) -> int:
        """Records that failed or were not acknowledged in time."""
        return self.producer.flush(seconds) + self.failed
