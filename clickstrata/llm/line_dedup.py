"""Line or paragraph deduplication by hashing.

Method: each text is cut into units; units are normalised (lower case, the six ASCII blanks to single spaces) and hashed
to 128 bits; digests are grouped over all texts; the earliest occurrence by (id, unit) stays and the others are removed.
The places of removed units in the input are kept, in code points.

Every unit with a word is hashed; ``least_words`` spares units of fewer words, and units without words are never removed.
Null texts count as empty. Repeated rows (id and text equal) are one document and are returned each time; rows that share
an id but not their text rank by their text's hash. A null id ranks first. A very long text is cut whole; a batch holds
at most 16 MB of texts, or one text. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import small_batches, written

#: What ends a unit.
BREAKS = {"line": "\n", "paragraph": "\n\n"}
LEAST_WORDS = 1


def unit_digests(texts: DataFrame, end: str, least_words: int) -> DataFrame:
    """did, hash, unit, digest of each unit that can be a copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, units, digests = [], [], []
            for row, text in enumerate(batch.column("text")):
                for unit, held in enumerate(text.as_py().split(end)):
                    words = held.lower().encode("utf-8", "replace").split()  # bytes split at the six ASCII blanks only
                    if words and len(words) >= least_words:
                        index.append(row)
                        units.append(unit)
                        digests.append(md5(b" ".join(words), usedforsecurity=False).digest())
            rows = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("did").take(rows), batch.column("hash").take(rows), pa.array(units, pa.int32()), pa.array(digests, pa.binary())], ["did", "hash", "unit", "digest"])

    return texts.select("did", "hash", "text").mapInArrow(run, "did long, hash long, unit int, digest binary")


CUT = "doc_id long, n_units long, n_removed long, spans array<struct<start:long,length:long>>, kept string"


def cut(texts: DataFrame, end: str) -> DataFrame:
    """Texts (doc_id, text, gone: units to remove) without those units."""
    fields = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_units, n_removed, spans, kept = [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                units, drop = text.as_py().split(end), set(gone.as_py() or ())
                at, found = 0, []
                for k, x in enumerate(units if drop else ()):
                    if k in drop:
                        found.append({"start": at, "length": len(x)})
                    at += len(x) + len(end)
                n_units.append(len(units))
                n_removed.append(len(found))
                spans.append(found)
                kept.append(end.join(x for k, x in enumerate(units) if k not in drop))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, fields), pa.array(kept, pa.string())], ["doc_id", "n_units", "n_removed", "spans", "kept"])

    return texts.select("doc_id", "text", "gone").mapInArrow(run, CUT)


def without_copies(docs: DataFrame, unit: str = "line", least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_units, n_removed, spans (start and length of removed units) and the kept text of every row."""
    end = BREAKS[unit]
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    units = written(unit_digests(texts, end, least_words), "units")
    rank = F.struct("did", "hash", "unit")
    # written apart, so that Spark can split a hot digest in the join
    first = written(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first-units")
    gone = units.join(first, "digest").where(rank != F.col("first")).groupBy("did", "hash").agg(F.collect_set("unit").alias("gone"))
    return cut(texts.join(gone, ["did", "hash"], "left"), end)
