"""Spark sessions and lake locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

#: Settings that the engine's results depend on: UTC days, partition-wise overwrite, state that can outgrow memory.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.orc.compression.codec": "zstd",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings that can change at run time to a session that exists."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def get_spark(app_name: str, master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config(map=SETTINGS | {k: str(v) for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, with a local master only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="clickstrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/clickstrata-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Lake:
    """Where tables and checkpoints lie."""

    root: str

    @classmethod
    def from_env(cls) -> Lake:
        return cls(os.environ.get("LAKE_ROOT", "hdfs:///lake"))

    def table(self, name: str) -> str:
        """``layer.table`` to its folder."""
        layer, table = name.split(".")
        return f"{self.root.rstrip('/')}/{layer}/{table}"

    def checkpoint(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/_checkpoints/{name}"

    @property
    def landing(self) -> str:
        return f"{self.root.rstrip('/')}/landing"
