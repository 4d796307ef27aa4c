"""Document fingerprints from spot signatures.

Method: common words are anchors. Each anchor that stands before a content word gives a signature: the anchor and the
chain of the next ``CHAIN`` content words, common words between them skipped. A text's fingerprint is its set of
signatures. Sets are compared by Jaccard similarity; near-duplicate search deals sets by length, since sets whose
lengths differ too much cannot be similar, and joins only on the rarest signatures of each set, of which similar sets
must share one. DataFrame functions only.

A text without signatures has its whole word sequence as its one signature; without words its set is empty. Two empty
sets are alike (1). Null texts count as empty; null ids are kept, and come last in descending order. Empty tables give no
rows. Rows that share id and text are one document, returned each time; rows that share only their id are ordered by
their text's hash. A very long text is one row: its words and signatures are in one task's memory at once. Columns
besides id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import let, neighbours, written

#: Common words of English, German, French and Spanish.
ANCHORS = tuple(
    sorted(
        set(
            (
                "a an and are as at be been but by for from had has have he her his in is it its not of on or she that the their they this to was were which will with you "
                "als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so und von war wie wird zu zum zur über "
                "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas plus pour que qui se ses son sur un une vous à "
                "al como con de del el en es esta este la las lo los más no para pero por que se sin sobre su sus un una y"
            ).split()
        )
    )
)
CHAIN = 2
#: Stands for a null id.
NO_ID = -(1 << 63)


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def signatures(text: Column) -> Column:
    """The sorted set of 64-bit signatures of a text."""

    def chains(held: Column) -> Column:
        n = F.size(held) - 1
        marked = F.zip_with(F.slice(held, F.lit(1), F.greatest(n, F.lit(0))), F.slice(held, F.lit(2), F.greatest(n, F.lit(0))), lambda a, b: F.struct(F.when(a.isin(*ANCHORS), a).alias("anchor"), b.alias("word")))
        content = F.filter(marked, lambda x: ~x["word"].isin(*ANCHORS))

        def signed(c: Column) -> Column:
            m = F.greatest(F.size(c) - 1, F.lit(0))
            found = F.zip_with(F.slice(c, F.lit(1), m), F.slice(c, F.lit(2), m), lambda x, y: F.when(x["anchor"].isNotNull(), F.xxhash64(x["anchor"], x["word"], y["word"])))
            return F.sort_array(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))

        whole = F.when(F.size(held) > 0, F.array(F.xxhash64(F.array_join(held, " ")))).otherwise(F.array().cast("array<bigint>"))
        return let(let(content, signed), lambda s: F.when(F.size(s) > 0, s).otherwise(whole))

    return let(words(text), chains)


def fingerprint(signed: Column) -> Column:
    """A digest of a set of signatures, as lowercase hex."""
    return F.sha2(F.array_join(signed.cast("array<string>"), " "), 256)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity; 0 without comparing where the lengths alone say that it is below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(large == 0, F.lit(1.0)).when(small < least * large, F.lit(0.0)).when(small == 0, F.lit(0.0)).otherwise(both)


def near_duplicates(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, representative) and links (a, b, likeness) between representatives of equal sets, at ``least`` or more."""
    signed = docs.select(F.col(id_col).alias("doc_id"), signatures(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    rows = written(signed.withColumn("fingerprint", fingerprint(F.col("s"))), "signatures")
    classes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("representative"), F.first("s").alias("s")).withColumn("n", F.size("s")), "signature-classes")
    members = rows.select("doc_id", "fingerprint").join(classes.select("fingerprint", "representative"), "fingerprint").select("doc_id", "representative")
    tokens = classes.where("n > 0").select("representative", "n", F.explode("s").alias("t"))
    common = written(tokens.groupBy("t").agg(F.count("*").alias("df")), "signature-counts")
    ranked = tokens.join(common.where("df > 1"), "t").groupBy("representative", "n").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("shared"))
    # signatures of one set only come first in the order but link nothing: the rest of the prefix is what they leave
    reach = F.greatest(F.size("shared") - F.ceil(F.lit(least) * F.col("n")).cast("int") + 1, F.lit(0))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / least)).cast("int")
    prefix = ranked.select("representative", "n", band.alias("band"), F.explode(F.slice("shared", F.lit(1), reach)).alias("x")).select("representative", "n", "band", F.col("x.t").alias("t"))
    one = prefix.select(F.col("representative").alias("a"), F.col("n").alias("an"), F.col("band").alias("ab"), "t", "band")
    # lengths of similar sets differ by a factor of 1/least at most: they lie in the same band or the next
    two = prefix.select(F.col("representative").alias("b"), F.col("n").alias("bn"), F.col("band").alias("bb"), "t", F.explode(F.array(F.col("band"), F.col("band") - 1, F.col("band") + 1)).alias("band"))
    pairs = one.join(two, ["t", "band"]).where((F.col("a") < F.col("b")) & (F.least("an", "bn") >= least * F.greatest("an", "bn"))).select("a", "b").distinct()
    sets = classes.select("representative", "s")
    linked = pairs.join(sets.select(F.col("representative").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("representative").alias("b"), F.col("s").alias("sb")), "b")
    return members, linked.select("a", "b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last half replaced by as much from the beginning of the next text by descending id. Each
    text moves once by its own key; half of the next text and its signatures move once to the text before.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = texts.select("did", "hash", F.length("text").cast("long").alias("n")).distinct().withColumn("key", F.struct("did", "hash"))
    order = neighbours(keys, [F.desc("did"), F.desc("hash")], True, "next", "key")
    givers = written(order.select(F.col("next.did").alias("did"), F.col("next.hash").alias("hash"), F.col("did").alias("to_did"), F.col("hash").alias("to_hash"), F.floor(F.col("n") / 2).cast("int").alias("half")), "givers")
    moved = texts.select("did", "hash", "text")  # both joins ask for the same columns, so the texts' exchange is used twice
    given = moved.join(givers.hint("merge"), ["did", "hash"]).dropDuplicates(["did", "hash"]).select(F.col("to_did").alias("did"), F.col("to_hash").alias("hash"), F.expr("left(text, half)").alias("given"), signatures(F.col("text")).alias("s_next"))
    both = moved.join(given, ["did", "hash"])
    n = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - int(floor(length(text) / 2)))"), F.col("given"))
    held = both.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), n.cast("long").alias("n_chars"), let(edited, lambda e: F.struct(F.sha2(e, 256).alias("sha"), signatures(e).alias("s"))).alias("e"), signatures(F.col("text")).alias("s"), "s_next")
    return held.select("doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), fingerprint(F.col("s")).alias("fingerprint"), fingerprint(F.col("e.s")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("e.s")).alias("near_edited"), likeness(F.col("s"), F.col("s_next")).alias("near_next"))
