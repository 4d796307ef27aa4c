"""The corpus pipeline: documents pass quality rules, toxicity, near-duplicate and repeated-passage removal, and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Null texts count as empty: the quality stage rejects them. Null ids are kept, and rank before all others where one row of
several stays. Rows equal in id and text share every verdict; one of them stays in the near-duplicate stage. Rows that
share only their id are told apart by their text's hash. Ties go to the least id, then the least hash. Very long texts are
read whole in each stage, in batches of 16 MB or one text. An empty table stays empty in each stage. Columns besides
those of documents end at the repeats stage, and clash with nothing: keys that stages add begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstrata.llm import packing, quality, repeats, simhash, toxicity
from clickstrata.llm.common import read_table, scratch, table_path
from clickstrata.llm.queries import WORD_VOCABULARY

#: Words of a passage that is removed where it repeats.
PASSAGE_WORDS = 50


def sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    keyed = docs.withColumn("__key", key)
    kept = quality.quality(keyed, id_col="__key").where("kept").select(F.col("doc_id").alias("__key")).distinct()
    return keyed.join(kept, "__key", "left_semi").drop("__key")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not score as toxic, by a model of the labelled rows of the corpus."""
    return toxicity.without_toxic(docs, toxicity.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.first_of_each_group(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of ``PASSAGE_WORDS`` words or more that stand anywhere else; n_chars follows the text.

    Every occurrence goes, the first too: what is left holds no such passage twice, nor one that other documents once held.
    """
    found = repeats.without_repeats(docs, repeats.Windows("words", PASSAGE_WORDS), columns=("lang", "source"))
    text = F.col("kept").cast("string")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences."""
    return packing.pack_documents(docs, WORD_VOCABULARY)


STAGES = [("quality", sound), ("toxicity", civil), ("near_duplicates", distinct), ("repeats", unrepeated), ("packing", packed)]
#: No SQL: covariance estimates, learnt grammars and token vocabularies have no DuckDB expression.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = table_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
