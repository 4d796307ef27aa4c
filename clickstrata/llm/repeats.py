"""Repeated passages: every unit covered by a window of ``window`` units that also starts anywhere else.

Method: a radix sort of suffixes, most significant digit first, that stops at the depth of the threshold; groups of
equal suffixes at that depth are exactly the repeated windows.

1. Choice of suffixes. In each window the block with the least digest is its anchor (the last, if several are least).
   Equal windows have equal anchors, so a window whose anchor stands nowhere else is in no group, and its suffix need
   not be sorted. This spares the shuffle of a row for each byte of the input; no repeated window is lost by it.
2. Dealing. The stretches of text that the other windows cover go to the task of their anchor.
3. Passes. Each task sorts its suffixes by one digit after the other (eight bytes, or one word), and goes on only with
   groups of two or more, until the threshold's depth. What is left are equal windows, compared unit by unit; they
   cover their text. The windows that one text itself repeats are found by the same passes before the dealing.
4. An anchor of over ``GROUP`` stretches is dealt to several tasks. Windows that such a task meets once go by a 128-bit
   digest of their units to one more grouping over all tasks.

Equal texts are taken once: with a copy, all their windows are repeated, and all of a text of ``window`` units or more
goes, the first copy's too. Every occurrence of a repeated passage goes, the first too. Bytes or words serve as units.
Null texts count as empty; null ids are kept. Empty tables give no rows. Repeated rows are copies of each other. A very
long text is worked on whole: about 40 times its bytes in memory for a while. Other columns pass through where the
caller asks for them by ``columns``, and are not read otherwise.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clickstrata.llm.common import BLANKS, small_batches, table_path, written

#: Stretches of one anchor that a task holds at once (of some 700 bytes each), and stretches that are worked on together.
GROUP, BLOCK = 8192, 2000
WORD = re.compile(f"[^{BLANKS}]+".encode())
#: Odd multipliers of the digests (from the golden ratio and its square root).
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Low bits of a block's sort key, which hold its place.
PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Windows:
    """units: "bytes" or "words"; window: the threshold in units."""

    units: str = "bytes"
    window: int = 400

    @property
    def block(self) -> int:
        return max(1, self.window // 3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x *= TWO
    x ^= x >> np.uint64(29)
    return x


BYTE_CODES = _mixed(_mixed(np.arange(1, 257, dtype=np.uint64) * ONE))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * ONE
    x += b
    return _mixed(x)


def digests(codes: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size the digests of all windows of so many codes: by doubling, the last two halves overlapping."""
    out: dict[int, np.ndarray] = {}
    held, width = codes, 1
    while True:
        for size in sizes:
            if width <= size < 2 * width:
                n = len(codes) - size + 1
                gap = size - width
                out[size] = np.zeros(0, np.uint64) if n <= 0 else _joined(held[:n], held[gap : gap + n])
        if 2 * width > max(sizes):
            return [out[s] for s in sizes]
        held = _joined(held[:-width], held[width:]) if len(held) > width else np.zeros(0, np.uint64)
        width *= 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while 2 * width <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    gap = size - width
    return np.minimum(x[: len(x) - gap], x[gap:]) if gap else x


def anchored(blocks: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share an anchor: first window, last window, the anchor's digest."""
    span = windows.window - windows.block + 1
    places = np.arange(len(blocks), dtype=np.uint64)
    least = sliding_min((blocks & ~PLACE) | (PLACE - (places & PLACE)), span)
    starts = places[: len(least)]
    at = PLACE - (least & PLACE) + (starts & ~PLACE)
    at += np.where(at < starts, PLACE + np.uint64(1), np.uint64(0))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    return first, last, blocks[at[first]]


def coded(raw: bytes, windows: Windows) -> tuple[np.ndarray, np.ndarray | None]:
    """The text's units as 64-bit codes and, for words, where each begins and ends."""
    if windows.units == "bytes":
        return BYTE_CODES[np.frombuffer(raw, np.uint8)], None
    spans = np.array([m.span() for m in WORD.finditer(raw)], np.int64).reshape(-1, 2)
    return np.fromiter((xxh64_intdigest(raw[a:b]) for a, b in spans.tolist()), np.uint64, len(spans)), spans


def spans_of(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digits_of(raw: bytes, windows: Windows) -> np.ndarray:
    """The radix digit that begins at each unit: eight bytes as a number in the order of the bytes, or a word's code."""
    if windows.units == "words":
        return np.frombuffer(raw, np.uint64)
    return np.ndarray((len(raw),), ">u8", raw + bytes(7), 0, (1,)).astype(np.uint64)


def equal_suffixes(digits: np.ndarray, starts: np.ndarray, group: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Radix sort, most significant digit first, of the suffixes that begin at ``starts`` (indices of ``digits``), to the depth
    of the window. ``group`` is what is sorted already: numbers in ascending order.

    Gives places in ``starts`` and their group's number, in ascending order of it, for the groups of two or more.
    """
    step = min(8, windows.window) if windows.units == "bytes" else 1
    shift = np.uint64(8 * (8 - step)) if windows.units == "bytes" else np.uint64(0)
    places = np.arange(len(starts))
    depths = [*range(0, windows.window - step, step), windows.window - step]
    for depth in depths:
        key = digits[starts[places] + depth]
        if shift:
            key = key >> shift
        same = group[1:] == group[:-1]
        differs = same & (key[1:] != key[:-1])
        if differs.any():
            number = np.cumsum(np.concatenate(([0], ~same)))
            mixed = np.zeros(number[-1] + 1, bool)
            mixed[number[1:][differs]] = True
            rows = np.flatnonzero(mixed[number])
            order = rows[np.lexsort((key[rows], number[rows]))]
            places[rows], key[rows] = places[order], key[order]
            differs = same & (key[1:] != key[:-1])
        number = np.cumsum(np.concatenate(([0], ~same | differs))) if len(places) else places
        kept = np.bincount(number)[number] > 1 if len(places) else np.zeros(0, bool)
        places, group = places[kept], number[kept]
        if not len(places):
            break
    return places, group


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def anchors(texts: DataFrame, windows: Windows) -> DataFrame:
    """anchor, did, hash, n: each text's anchors and how many of its runs have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes, counts = [], [], []
            for x in batch.column("text"):
                codes, _ = coded(x.as_py().encode("utf-8", "replace"), windows)
                if len(codes) < windows.window:
                    sizes.append(0)
                    continue
                (blocks,) = digests(codes, windows.block)
                keys, n = np.unique(anchored(blocks, windows)[2], return_counts=True)
                found.append(keys)
                counts.append(n)
                sizes.append(len(keys))
            index = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            none = np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([none, *found])), batch.column("did").take(index), batch.column("hash").take(index), pa.array(np.concatenate([none.astype(np.int64), *counts]), pa.int64())], ["anchor", "did", "hash", "n"])

    return texts.select("did", "hash", "text").mapInArrow(run, "anchor long, did long, hash long, n long")


STRETCH = "anchor long, part int, parts int, did long, hash long, first long, weight int, codes binary"


def stretches(texts: DataFrame, windows: Windows) -> DataFrame:
    """For rows (did, hash, text, copies, again: anchors that occur again and their number of parts) the stretches of those.

    Windows that a text itself repeats are covered at once: rows with no anchor, where first and weight are the covered
    stretch's begin and length. Of equal windows within a text only the first goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for did, hash_, text, copies, again in zip(*(batch.column(c) for c in ("did", "hash", "text", "copies", "again")), strict=True):
                raw = text.as_py().encode("utf-8", "replace")
                codes, _ = coded(raw, windows)
                (blocks,) = digests(codes, windows.block)
                first, last, keys = anchored(blocks, windows)
                parts = {k & (1 << 64) - 1: p for k, p in ((e["anchor"], e["parts"]) for e in again.as_py())}
                kept = np.isin(keys, np.fromiter(parts, np.uint64, len(parts)))
                place = did.as_py(), hash_.as_py()
                if not kept.any():
                    continue
                first, last, keys = first[kept], last[kept], keys[kept]
                lengths = last - first + 1
                at = (np.repeat(first, lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int64)
                held = raw if windows.units == "bytes" else codes.tobytes()
                twice, group = equal_suffixes(digits_of(held, windows), at, np.zeros(len(at), np.int64), windows)
                if len(twice) and copies.as_py() == 1:
                    rows += [(None, 0, 1, *place, int(a), int(b - a), None) for a, b in covered(at[twice], windows.window)]
                fresh = np.ones(len(at), bool)
                fresh[twice] = False
                if len(twice):  # of each group the earliest
                    order = np.lexsort((at[twice], group))
                    fresh[twice[order][np.flatnonzero(np.concatenate(([True], np.diff(group[order]) > 0)))]] = True
                runs = np.logical_or.reduceat(fresh, np.cumsum(lengths) - lengths)
                weight = 1 if copies.as_py() == 1 else 2
                size = 1 if windows.units == "bytes" else 8
                for a, b, k in zip(first[runs].tolist(), last[runs].tolist(), keys[runs].tolist(), strict=True):
                    n = parts[k]
                    rows.append((k - (1 << 64) if k >> 63 else k, (place[1] ^ a) % n, n, *place, a, weight, held[a * size : (b + windows.window) * size]))
            yield pa.RecordBatch.from_pylist([], schema=_STRETCH) if not rows else pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _STRETCH, strict=True)], schema=_STRETCH)

    return texts.select("did", "hash", "text", "copies", "again").mapInArrow(run, STRETCH)


_STRETCH = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("did", pa.int64()), ("hash", pa.int64()), ("first", pa.int64()), ("weight", pa.int32()), ("codes", pa.binary())])


def covered(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches that windows at these places cover."""
    starts = np.unique(starts)
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    return [(int(s[0]), int(s[-1]) + window) for s in np.split(starts, cut)]


FOUND = "did long, hash long, begin long, stop long, digest binary, weight int"
_FOUND = pa.schema([("did", pa.int64()), ("hash", pa.int64()), ("begin", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary()), ("weight", pa.int32())])


def ordered(dealt: DataFrame, windows: Windows) -> DataFrame:
    """Covered stretches (did, hash, begin, stop) of each anchor's suffixes, sorted; for parts of a large anchor also, with a
    digest, the windows met once and, without a place, one row for each window met again."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        """rows: stretches in the order of their anchor and part."""
        out: list[tuple] = []
        w, scale = windows.window, 1 if windows.units == "bytes" else 8
        held = b"".join(r[7] for r in rows)
        sizes = np.array([len(r[7]) // scale for r in rows])
        number = sizes - w + 1
        owner = np.repeat(np.arange(len(rows)), number)
        offset = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
        starts = (np.cumsum(sizes) - sizes)[owner] + offset
        anchor = np.array([r[0] for r in rows])
        part = np.array([r[1] for r in rows])
        dealt_to = np.cumsum(np.concatenate(([0], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
        places, group = equal_suffixes(digits_of(held, windows), starts, dealt_to[owner], windows)
        lowest = np.full(len(rows), 1 << 62)
        highest = np.full(len(rows), -1)
        np.minimum.at(lowest, owner[places], offset[places])
        np.maximum.at(highest, owner[places], offset[places])
        for i in np.flatnonzero(highest >= 0).tolist():
            _, _, _, did, hash_, first, weight, _ = rows[i]
            if weight == 1:
                out.append((did, hash_, first + int(lowest[i]), first + int(highest[i]) + w, None, 0))
        large = np.array([r[2] > 1 for r in rows])[owner]
        if large.any():
            digest = lambda j: md5(rows[owner[j]][0].to_bytes(8, "little", signed=True) + held[starts[j] * scale : (starts[j] + w) * scale], usedforsecurity=False).digest()
            copied = np.array([r[6] > 1 for r in rows])[owner]
            again = np.zeros(len(owner), bool)
            again[places] = True
            for j in np.flatnonzero(large & ~again & ~copied).tolist():
                r = rows[owner[j]]
                at = r[5] + int(offset[j])
                out.append((r[3], r[4], at, at + w, digest(j), 1))
            one_each = places[np.concatenate(([True], np.diff(group) > 0))] if len(places) else places
            for j in [*one_each[large[one_each]].tolist(), *np.flatnonzero(large & ~again & copied).tolist()]:
                out.append((None, None, None, None, digest(j), 2))
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND) if out else pa.RecordBatch.from_pylist([], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        group: list[tuple] = []
        key = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != key:
                    if len(group) > 1 or group and group[0][2] > 1:
                        rows += group
                        if len(rows) >= BLOCK:
                            yield work(rows)
                            rows = []
                    key, group = row[:2], []
                group.append(row)
        if len(group) > 1 or group and group[0][2] > 1:
            rows += group
        if rows:
            yield work(rows)

    return dealt.mapInArrow(run, FOUND)


def covers(texts: DataFrame, windows: Windows) -> DataFrame:
    """did, hash, spans of every text (did, hash, text, copies: one copy) in which something is repeated."""
    keys = written(anchors(texts, windows), "anchors")
    # written apart, so that Spark can split a hot anchor in the join
    again = written(keys.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", F.ceil(F.col("total") / GROUP).cast("int").alias("parts")), "again")
    lists = keys.select("anchor", "did", "hash").join(again, "anchor").groupBy("did", "hash").agg(F.collect_list(F.struct("anchor", "parts")).alias("again"))
    made = written(stretches(texts.join(lists, ["did", "hash"]), windows), "stretches")
    met = made.where("anchor is not null").repartition("anchor", "part").sortWithinPartitions("anchor", "part", "did", "hash", "first")
    found = written(ordered(met, windows), "covered")
    own = made.where("anchor is null").select("did", "hash", F.col("first").alias("begin"), (F.col("first") + F.col("weight")).alias("stop"))
    single = found.where("digest is not null")
    twice = single.groupBy("digest").agg(F.sum("weight").alias("total")).where("total > 1").select("digest")
    late = single.where("did is not null").join(twice, "digest").select("did", "hash", "begin", "stop")
    sure = found.where("digest is null").select("did", "hash", "begin", "stop")
    every = own.unionByName(sure).unionByName(late)
    return every.groupBy("did", "hash").agg(F.collect_set(F.struct("begin", "stop")).alias("spans"))


def distinct_texts(docs: DataFrame, id_col: str, text_col: str, columns: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (did, hash: the class; doc_id and row: the other columns asked for, of a text without copies; text,
    copies), bucketed by class, and the rows (doc_id, row, did, hash) of texts with copies.

    A class is named by its least id and its text's hash; texts move once, and later joins find them in place.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = F.struct(*[F.col(c) for c in columns] or [F.lit(True).alias("none")]).alias("row")
    named = docs.select(F.col(id_col).alias("doc_id"), others, F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("did"), text.alias("text"))
    named = named.withColumn("hash", F.xxhash64("text"))
    rows = written(named.select("doc_id", "row", "did", "hash", F.unhex(F.md5("text")).alias("digest")), "digests")
    classes = written(rows.groupBy("digest").agg(F.min("did").alias("class_did"), F.first("hash").alias("class_hash"), F.count("*").alias("copies")), "classes")
    members = rows.join(classes.where("copies > 1").select("digest", "class_did", "class_hash"), "digest").select("doc_id", "row", F.col("class_did").alias("did"), F.col("class_hash").alias("hash"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = classes.select(F.col("class_did").alias("did"), F.col("class_hash").alias("hash"), "copies").repartition(buckets, "did", "hash")
    # repeated ids with equal texts come several times: one of them stays
    held = named.repartition(buckets, "did", "hash").join(chosen, ["did", "hash"]).withColumn("copies", F.col("copies").cast("int")).dropDuplicates(["did", "hash"])
    name = f"texts_{uuid.uuid4().hex}"
    held.write.format("parquet").option("compression", "zstd").option("path", table_path(spark, "texts")).bucketBy(buckets, "did", "hash").saveAsTable(name)
    texts = spark.table(name)
    texts.schema  # noqa: B018  resolved, with its buckets, before the catalog forgets the name; the files stay
    spark.sql(f"DROP TABLE {name}")
    return members, texts


def cut(texts: DataFrame, windows: Windows) -> DataFrame:
    """did, hash, doc_id, row, kept bytes, n_bytes, n_removed, spans (byte offsets in the input) of texts (did, hash, doc_id,
    row, text, copies, spans: of units)."""
    fields = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
    through = ["did", "hash", "doc_id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, removed, spans = [], [], [], []
            for text, copies, found in zip(batch.column("text"), batch.column("copies"), batch.column("spans"), strict=True):
                raw = text.as_py().encode("utf-8", "replace")
                where = [(s["begin"], s["stop"]) for s in found.as_py() or []]
                places = None
                if windows.units == "words" and (where or copies.as_py() > 1):
                    places = [m.span() for m in WORD.finditer(raw)]
                n = len(raw) if windows.units == "bytes" else len(places or [])
                if copies.as_py() > 1:
                    where = [(0, n)] if n >= windows.window else []
                where = spans_of(where)
                if places is not None:
                    where = [(places[a][0], places[b - 1][1]) for a, b in where]
                at, parts = 0, []
                for a, b in where:
                    parts.append(raw[at:a])
                    at = b
                parts.append(raw[at:])
                kept.append(b"".join(parts))
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                spans.append([{"begin": a, "stop": b} for a, b in where])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in through], pa.array(kept, pa.binary()), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, fields)], [*through, "kept", "n_bytes", "n_removed", "spans"])

    made = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in through)
    return texts.select(*through, "text", "copies", "spans").mapInArrow(run, f"{made}, kept binary, n_bytes long, n_removed long, spans array<struct<begin:long,stop:long>>")


def without_repeats(docs: DataFrame, windows: Windows = Windows(), id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = (), digest_only: bool = False) -> DataFrame:  # noqa: B008
    """doc_id, the other ``columns`` asked for, n_bytes, n_removed, spans (byte offsets) and the kept bytes, or with
    ``digest_only`` their sha256, of every row."""
    small_batches(docs.sparkSession)
    members, texts = distinct_texts(docs, id_col, text_col, columns)
    found = covers(texts.where(F.octet_length("text") >= windows.window), windows)
    none = F.lit(None).cast("array<struct<begin:bigint,stop:bigint>>")
    outcome = ["n_bytes", "n_removed", "spans", "kept"]
    single = cut(texts.where("copies = 1").join(found, ["did", "hash"], "left"), windows).select("doc_id", "row", *outcome)
    # of a text with copies nothing is kept, or it is shorter than a window: what its rows are joined with is narrow
    shared = written(cut(texts.where("copies > 1").withColumn("spans", none), windows).select("did", "hash", *outcome), "shared-texts")
    done = single.unionByName(members.join(shared, ["did", "hash"]).select("doc_id", "row", *outcome))
    if digest_only:
        done = done.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    return done.select("doc_id", *[F.col(f"row.`{c}`") for c in columns], *[c for c in done.columns if c not in ("doc_id", "row")])
