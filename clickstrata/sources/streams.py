"""Stream and batch sources of the bronze layer: Kafka, text directories, Parquet directories, CSV exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickstrata import schemas

CSV_WITH_CORRUPT = T.StructType([*schemas.MARKETPLACE_CSV.fields, T.StructField(schemas.CORRUPT, T.StringType())])


@dataclass(frozen=True)
class KafkaSource:
    """Options of a Kafka stream; the connector is a package that the cluster provides."""

    bootstrap: str
    topic: str
    max_offsets_per_trigger: int = 500_000
    starting_offsets: str = "earliest"

    def options(self) -> dict[str, str]:
        return {
            "kafka.bootstrap.servers": self.bootstrap,
            "subscribe": self.topic,
            "startingOffsets": self.starting_offsets,
            "failOnDataLoss": "false",
            "maxOffsetsPerTrigger": str(self.max_offsets_per_trigger),
        }

    def stream(self, spark: SparkSession) -> DataFrame:
        return kafka_envelope(spark.readStream.format("kafka").options(**self.options()).load())


@dataclass(frozen=True)
class TextSource:
    """A directory of NDJSON files, compressed or not, one payload a line."""

    path: str
    max_files_per_trigger: int = 100

    def stream(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.format("text").option("maxFilesPerTrigger", self.max_files_per_trigger).option("recursiveFileLookup", "true")
        return file_envelope(reader.load(self.path))

    def batch(self, spark: SparkSession) -> DataFrame:
        return file_envelope(spark.read.format("text").option("recursiveFileLookup", "true").load(self.path))


def kafka_envelope(records: DataFrame) -> DataFrame:
    """Kafka records as envelope rows without ingest columns."""
    return records.select(
        F.col("value").cast("string").alias("raw_payload"),
        F.lit("kafka").alias("source"),
        F.concat_ws("/", "topic", F.col("partition").cast("string")).alias("source_ref"),
        F.col("partition").cast("int").alias("kafka_partition"),
        F.col("offset").cast("bigint").alias("kafka_offset"),
        F.col("timestamp").cast("timestamp").alias("source_ts"),
    )


def file_envelope(lines: DataFrame) -> DataFrame:
    """Text lines as envelope rows without ingest columns."""
    return lines.select(
        F.col("value").alias("raw_payload"),
        F.lit("files").alias("source"),
        F.col("_metadata.file_path").alias("source_ref"),
        F.lit(None).cast("int").alias("kafka_partition"),
        F.lit(None).cast("bigint").alias("kafka_offset"),
        F.lit(None).cast("timestamp").alias("source_ts"),
    )


def stamped(envelope: DataFrame, at=None) -> DataFrame:
    """With ingest time and date; one time for all rows of an execution, or the one given."""
    now = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    return envelope.withColumn("ingest_ts", now).withColumn("ingest_date", F.to_date("ingest_ts"))


def bronze_stream(spark: SparkSession, path: str, table: schemas.Table, max_files_per_trigger: int = 30) -> DataFrame:
    """A bronze table as a stream. The declared schema holds the partition column, so an empty folder can be watched."""
    return spark.readStream.schema(table.struct).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path).select(*table.fields)


def csv_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows of a marketplace CSV export and the lines whose columns do not fit; the header must be the known one."""
    header = ",".join(schemas.MARKETPLACE_CSV.fieldNames())
    lines = spark.read.text(path)
    first = lines.first()
    if first is None or first[0].strip() != header:
        raise ValueError(f"{path}: the header is not {header}")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT}
    rows = lines.where(F.trim("value") != header).select("value", F.from_csv("value", CSV_WITH_CORRUPT.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    good = F.col(f"r.{schemas.CORRUPT}").isNull()
    return rows.where(good).select("r.*").drop(schemas.CORRUPT), rows.where(~good).select(F.col("value").alias(schemas.CORRUPT))
