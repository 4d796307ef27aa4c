"""The registered queries of the corpus operators: (spark, sf_dir) to a DataFrame, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickstrata.llm import bytebpe, html_text, line_dedup, packing, quality, repeats, simhash, spot_signatures, token_counts, toxicity
from clickstrata.llm.common import read_table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spot_signatures.edited_likeness(read_table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(read_table(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return counts.withColumn("over_limit", F.col("n_tokens") > packing.CAPACITY)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint")))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytebpe.round_trip(read_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op8_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(read_table(spark, sf_dir, "documents"))
    # cuts may fall inside a character: the digest is over the bytes, the text shows such remains as U+FFFD
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(read_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.without_copies(read_table(spark, sf_dir, "documents"))
    places = F.array_join(F.transform("spans", lambda s: F.concat_ws("+", s["start"].cast("string"), s["length"].cast("string"))), " ")
    return found.select("doc_id", "n_units", "n_removed", places.alias("removed"), F.length("kept").cast("long").alias("n_kept_chars"), F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").alias("text"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_spot_signatures, op3_quality_rules, op4_token_counts, op5_toxicity, op6_simhash, op7_bpe_round_trip, op8_repeated_substrings, op9_html_text, op10_line_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op10_line_dedup": f"""
        WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents),
        units AS (SELECT doc_id, unnest(held) AS line, unnest(range(len(held))) AS no FROM cut),
        plain AS (SELECT *, trim(regexp_replace(lower(line), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS norm,
            coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM units),
        ranked AS (SELECT *, len(string_split(norm, ' ')) >= {line_dedup.LEAST_WORDS} AND norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, no) > 1 AS gone FROM plain)
        SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
            coalesce(string_agg(start || '+' || length(line), ' ' ORDER BY no) FILTER (WHERE gone), '') AS removed,
            length(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS n_kept_chars,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256,
            coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '') AS text
        FROM ranked GROUP BY doc_id""",
}
