"""Token counts through a digest cache.

Method: each text's normalised content and the tokenizer's version give a digest; digests are joined to stored
counts, only distinct misses are encoded, and their counts are appended to the cache, a Parquet table.

Normalising turns each run of white space into one space and trims, which this kind of tokenizer drops anyway; texts
that hold a special string are taken as they are. Null texts count as empty; null ids are kept. Empty tables give no rows
and leave the cache as it is. Repeated rows are counted once and returned each time; of the rows with one content the one
with the least id, then any, is encoded. A very long text is encoded whole; a batch holds at most 16 MB of texts, or one
text. Columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import BLANKS, small_batches, table_path, written
from clickstrata.llm.wordbpe import word_tokens

CACHE = "digest binary, n_tokens long"


def version(vocabulary: str) -> str:
    """The tokenizer's version: a digest of its vocabulary file, which the library reads from a local path."""
    return hashlib.sha256(Path(vocabulary).read_bytes()).hexdigest()


def digest(text: Column, vocabulary: str) -> Column:
    """32 bytes of the normalised content and the tokenizer's version."""
    plain = F.when(text.contains("<|"), text).otherwise(F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " ")))
    return F.unhex(F.sha2(F.concat(F.lit(version(vocabulary)), plain), 256))


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """digest, n_tokens of rows (digest, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(tokens.ids(x.as_py())) // 4 for x in batch.column(1)], pa.int64())], ["digest", "n_tokens"])

    return docs.select("digest", "text").mapInArrow(count, CACHE)


def stored(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, vocabulary: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row; ``cache`` is the path of the stored counts (a new one if not given).

    Texts are moved only where they are misses: once, by digest-free id. Of the cache, whose size is that of all corpora so
    far, only what this run's digests ask for is kept or written again; it is dealt by digest once. A digest that a third
    of all rows share is one row in it; the join back to the rows is a plain equi-join that Spark splits.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache = cache or table_path(spark, "token-counts")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # ids may repeat or be null: the text's own hash tells their rows apart
    keys = [F.coalesce("doc_id", F.lit(-1)).alias("key"), F.xxhash64("text").alias("hash")]
    rows = written(texts.select("doc_id", *keys, F.octet_length("text").cast("long").alias("n_bytes"), digest(F.col("text"), vocabulary).alias("digest")), "digests")
    asked = written(rows.groupBy("digest").agg(F.min("key").alias("key"), F.min_by("hash", "key").alias("hash")), "distinct-digests")
    # other writers may have appended the same digest
    known = written(stored(spark, cache).join(asked.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
    chosen = asked.join(known.select("digest"), "digest", "left_anti")
    misses = texts.select("text", *keys).join(chosen, ["key", "hash"]).dropDuplicates(["key", "hash"])
    fresh = written(counted(misses, vocabulary), "misses")
    fresh.write.mode("append").parquet(cache)
    # both are written apart, so that Spark can split a hot digest in the join
    return rows.join(known.unionByName(fresh), "digest").select("doc_id", "n_bytes", "n_tokens")
