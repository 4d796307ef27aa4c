"""SimHash fingerprints linked through BK-trees, and near-duplicate texts found with them.

Method: each text's word shingles vote on the bits of a fingerprint. Distinct fingerprints are dealt into shards by the
values of some of their blocks: of ``blocks`` blocks, two fingerprints that differ in at most blocks - equal bits agree
in ``equal`` of them, so they meet in a shard. Each shard builds a BK-tree, whose children are keyed by Hamming distance
to their parent, and each fingerprint of the shard follows only the edges within the radius. A shard keeps a forest of
its links; stars over the forests of all shards give the components.

Near-duplicate texts are those whose sets of word shingles have a cosine of 0.8 or more, the similarity that differing bits
of SimHash estimate: fingerprints and rare shared shingles give candidates, the sets themselves decide.

Trees are not broadcast: their size grows with the corpus and has no bound. They are dealt to tasks instead. A shard
over ``SHARD`` rows is cut into parts of about so many; each part is a tree, and each part searches each tree in a task
of its own, so that a task holds one tree and one part's queries, however large the shard is.

Null texts and texts without words have fingerprint zero. Null ids are kept; a class of only null ids has a null
component_id, and in ``first_of_each_group`` a null id ranks before all others. Ties: rows equal in id and text are one
row to ``first_of_each_group``, and rows that share only their id rank by their text's hash. A very long text is hashed
whole, 8,192 shingles at a time; its task holds all its shingles' hashes. Empty tables give no rows. Repeated rows
share a class. Columns besides id and text are ignored, and returned as they are by ``first_of_each_group``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clickstrata.llm.common import components, small_batches, written

SEED = 42
#: Tree rows that a shard's task holds, and queries, about.
SHARD = 4000
#: What ``plain`` shingles take for words: runs of letters and digits.
WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Links:
    """How fingerprints are compared: words in a shingle, bits, radius, blocks and how many of them a shard's key takes.

    Every link is found if radius <= blocks - equal; else two fingerprints meet with the probability that ``equal``
    blocks agree. If ``once``, a shingle votes once however often the text repeats it. If ``plain``, words are runs of
    letters and digits in lower case, so that edits of punctuation and case change no shingle.
    """

    shingle: int = 3
    bits: int = 64
    radius: int = 2
    blocks: int = 4
    equal: int = 2
    once: bool = False
    plain: bool = False

    def cuts(self) -> list[tuple[int, int]]:
        """Shift and mask of each block."""
        edges = [self.bits * k // self.blocks for k in range(self.blocks + 1)]
        return [(a, (1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def shingles(text: str, size: int, plain: bool = False) -> list[bytes]:
    """Word shingles, repeats included, of the text with A-Z in lower case; fewer words are one shingle. ``plain`` words are
    those of ``WORD``; a text without any is taken as if it were not plain."""
    words = " ".join(WORD.findall(text.lower())).encode("utf-8", "replace").split() if plain else []
    words = words or text.encode("utf-8", "replace").lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)))


def fingerprint(text: str, size: int, bits: int, once: bool = False, plain: bool = False) -> bytes:
    """Big-endian; a bit is set if over half of the shingles' hashes have it. Bits beyond 64 come
    from the same hashes, mixed again."""
    held = shingles(text, size, plain)
    if once:
        held = list(set(held))
    if not held:
        return bytes(bits // 8)
    first = np.fromiter(map(_hash, held), np.uint64, len(held))
    out = []
    for k in range(bits // 64):
        hashes = first if k == 0 else _spread(first + np.uint64(k * GOLDEN & 0xFFFFFFFFFFFFFFFF))
        votes = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 8192):
            part = hashes[at : at + 8192].astype("<u8", copy=False)
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out.append(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes()[::-1])
    return b"".join(out)


#: The increment and multipliers of the public splitmix64 generator.
GOLDEN = 0x9E3779B97F4A7C15


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(shingle: bytes) -> int:
    return xxh64_intdigest(shingle, SEED)


def fingerprints(docs: DataFrame, links: Links, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (binary) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py() or "", links.shingle, links.bits, links.once, links.plain) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "fingerprint"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint binary")


class BKTree:
    """Fingerprints as integers; children by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            distance = (self.values[at] ^ value).bit_count()
            after = self.children[at].setdefault(distance, new)
            if after == new:
                return
            at = after

    def within(self, value: int, radius: int) -> list[int]:
        """Places of the fingerprints within the radius."""
        if not self.values:
            return []
        found, open_ = [], [0]
        values, children = self.values, self.children
        while open_:
            at = open_.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            if below := children[at]:
                if len(below) <= 2 * radius:
                    open_ += [k for d, k in below.items() if -radius <= d - distance <= radius]
                else:
                    open_ += [below[d] for d in range(distance - radius, distance + radius + 1) if d in below]
        return found


def forest(values: list[int], trees: int, radius: int) -> list[tuple[int, int]]:
    """Links that connect the values: the first ``trees`` are the tree; where others follow, they search it, else the tree's
    own values do. Pairs of places."""
    parent = list(range(len(values)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    tree, out = BKTree(), []
    alone = trees == len(values)
    for place, value in enumerate(values):
        for hit in tree.within(value, radius) if alone or place >= trees else ():
            a, b = root(hit), root(place)
            if a != b:
                parent[b] = a
                out.append((hit, place))
        if place < trees:
            tree.add(value)
    return out


def shard_links(classes: DataFrame, links: Links) -> DataFrame:
    """Links (a, b) between the nodes of ``classes`` (node, fingerprint) that connect whatever lies within the radius."""
    cuts = links.cuts()
    choices = list(combinations(range(links.blocks), links.equal))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes] = []
            for x in batch.column("fingerprint"):
                value = int.from_bytes(x.as_py())
                parts = [value >> shift & mask for shift, mask in cuts]
                keys += [bytes([n]) + b"".join(parts[k].to_bytes(4) for k in chosen) for n, chosen in enumerate(choices)]
            index = np.repeat(np.arange(batch.num_rows), len(choices))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("node").take(pa.array(index)), batch.column("fingerprint").take(pa.array(index))], ["shard", "node", "fingerprint"])

    rows = classes.select("node", "fingerprint").mapInArrow(deal, "shard binary, node long, fingerprint binary")
    sizes = written(rows.select("shard").groupBy("shard").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / SHARD).cast("int")).select("shard", "parts"), "shards")
    met = rows.join(sizes, "shard").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # a part is the tree of its own task and of those of the parts after it, and the queries of the trees before it
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"tree": F.least("own", "with"), "part": F.greatest("own", "with")})
    met = met.repartition("shard", "tree", "part").sortWithinPartitions("shard", "tree", "part", F.desc(F.col("tree") == F.col("own")), "node")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, values, trees = None, [], [], 0

        def linked() -> pa.RecordBatch:
            found = forest(values, trees, links.radius)
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in found], pa.int64()), pa.array([nodes[b] for _, b in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for shard, tree, part, node, print_, own in zip(*(batch.column(c).to_pylist() for c in ("shard", "tree", "part", "node", "fingerprint", "own")), strict=True):
                if key != (shard, tree, part):
                    if len(nodes) > 1:
                        yield linked()
                    key, nodes, values, trees = (shard, tree, part), [], [], 0
                nodes.append(node)
                values.append(int.from_bytes(print_))
                trees += own == tree
        if len(nodes) > 1:
            yield linked()

    return met.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, links: Links = Links(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """doc_id, fingerprint (binary) and component_id, the least doc_id that links reach, of every row."""
    rows = written(fingerprints(docs, links, id_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "classes")
    roots = components(shard_links(classes, links))
    joined = written(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("fingerprint", "root", "least"), "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = written(joined.join(least, "root").select("fingerprint", "component_id"), "component-ids")
    return rows.join(by_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


#: Links for near-duplicate texts: wide fingerprints of five-word shingles, a radius that reaches well past a similarity of 0.8.
WIDE = Links(shingle=5, bits=384, radius=84, blocks=32, equal=1, once=True, plain=True)
#: Fingerprints that share a band by chance, about: bands widen with the corpus so that it stays so many.
CHANCE = 16
#: Texts of one candidate component that are compared in one task, about, and shingles of theirs; texts of a larger one that all others are compared with first.
COMPARED, HELD, PIVOTS = 1500, 2_000_000, 16
#: Shingles that are counted together, and the least number of parts they are dealt to.
COUNTED, LEAST_PARTS = 2_000_000, 64


def widened(links: Links, n: int) -> Links:
    """links for n fingerprints: fewer and wider bands where ``n`` is so large that many would share one by chance."""
    width = max(links.bits // links.blocks, math.ceil(math.log2(max(n, 1) / CHANCE)) if n > CHANCE else 0)
    return replace(links, blocks=links.bits // width)


def shingle_set(text: str, size: int, plain: bool = False) -> bytes:
    """The sorted set of the shingles' 64-bit hashes."""
    return np.unique(np.fromiter(map(_hash, shingles(text, size, plain)), np.uint64)).tobytes()


def _packed(key: np.ndarray, parts: int, *columns: np.ndarray) -> Iterator[tuple]:
    """Key and the columns' bytes, for each key from 0 to parts - 1 that has rows."""
    order = np.argsort(key, kind="stable")
    edges = np.searchsorted(key[order], np.arange(parts + 1))
    held = [c[order] for c in columns]
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, *[c[edges[k] : edges[k + 1]].tobytes() for c in held]


def _groups(batches: Iterator[pa.RecordBatch], key: str, columns: dict[str, type], fixed: str | None = None) -> Iterator[tuple]:
    """Key and the joined columns of each run of rows that share the key; with ``fixed``, also that column, repeated."""
    last, held = None, []

    def joined() -> tuple:
        made = [np.concatenate([np.frombuffer(row[c], t) for row in held]) for c, t in columns.items()]
        if fixed:
            first = next(iter(columns))
            width = np.dtype(columns[first]).itemsize
            made.append(np.repeat([row[fixed] for row in held], [len(row[first]) // width for row in held]))
        return last, *made

    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != last:
                yield joined()
                held = []
            last = row[key]
            held.append(row)
    if held:
        yield joined()


def rare_links(texts: DataFrame, shingle: int, least: float, plain: bool = False) -> DataFrame:
    """Links (a, b) that connect all texts (node, text) whose shingle sets can have a similarity of ``least`` or more.

    Prefix filter: two such sets, of n and m shingles, share least sqrt(n m) or more, and m is least**2 n or more; so they
    share one of the n - ceil(least**2 n) + 1 shingles of each that come first in any order
    over all shingles. In the order taken, by the number of texts, those that only one text has come first, and link
    nothing; so only texts mostly made of what others hold too have any. Holders of one shingle are linked to the least.
    Shingles are packed by parts of the hash range, and counts by parts of the nodes, each of bounded mean size.
    """
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, 1 << int(chars // 6 // COUNTED).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(x) for x in sets], np.uint32)
            hashes = np.concatenate(sets)
            rows = list(_packed(((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), parts, hashes.astype(np.uint32), np.repeat(np.array(nodes, np.int64), sizes), np.repeat(sizes, sizes)))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "shingles", "nodes", "sizes"])

        seen, nodes, sets, many = set(), [], [], 0
        for batch in batches:
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text"), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                own = np.unique(np.fromiter(map(_hash, shingles(text.as_py(), shingle, plain)), np.uint64))
                if len(own):
                    nodes.append(node)
                    sets.append(own)
                    many += len(own)
                if many >= COUNTED // 2:
                    yield made(nodes, sets)
                    seen, nodes, sets, many = set(), [], [], 0
        if sets:
            yield made(nodes, sets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, nodes, sizes in _groups(batches, "part", {"shingles": np.uint32, "nodes": np.int64, "sizes": np.uint32}):
            order = np.lexsort((nodes, found))
            found, nodes, sizes = found[order], nodes[order], sizes[order]
            new = np.r_[True, (found[1:] != found[:-1]) | (nodes[1:] != nodes[:-1])]
            found, nodes, sizes = found[new], nodes[new], sizes[new]
            starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            holders = np.diff(np.r_[starts, len(found)])
            holders = np.repeat(holders, holders)
            more = holders > 1
            if not more.any():
                continue
            found, nodes, sizes, holders = found[more], nodes[more], sizes[more], np.minimum(holders[more], 65535).astype(np.uint16)
            order = np.argsort(nodes, kind="stable")
            rows = list(_packed((nodes % parts)[order], parts, found[order], nodes[order], sizes[order], holders[order]))
            columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([part] * len(rows), pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5)]]
            yield pa.RecordBatch.from_arrays(columns, ["own", "part", "shingles", "nodes", "sizes", "holders"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, nodes, sizes, holders, part in _groups(batches, "own", {"shingles": np.uint32, "nodes": np.int64, "sizes": np.uint32, "holders": np.uint16}, "part"):
            order = np.lexsort((found, part, holders, nodes))
            found, nodes, sizes, part = found[order], nodes[order], sizes[order].astype(np.int64), part[order].astype(np.int64)
            starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            shared = np.diff(np.r_[starts, len(nodes)])
            rank = np.arange(len(nodes)) - np.repeat(starts, shared)
            prefix = sizes - np.ceil(least * least * sizes - 1e-9).astype(np.int64) + 1
            kept = rank < prefix - (sizes - np.repeat(shared, shared))
            yield pa.RecordBatch.from_arrays([pa.array(part[kept] << 32 | found[kept].astype(np.int64)), pa.array(nodes[kept])], ["shingle", "node"])

    dealt = texts.select("node", "text").mapInArrow(deal, "part int, shingles binary, nodes binary, sizes binary").repartition("part").sortWithinPartitions("part")
    counted = dealt.mapInArrow(count, "own int, part int, shingles binary, nodes binary, sizes binary, holders binary").repartition("own").sortWithinPartitions("own")
    held = written(counted.mapInArrow(first, "shingle long, node long"), "rare-shingles")
    least_node = held.groupBy("shingle").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return held.join(least_node, "shingle").where("node <> a").select("a", F.col("node").alias("b"))


def similar(sets: list[np.ndarray], left: int, least: float) -> list[tuple[int, int]]:
    """Links that connect all sets with a similarity of ``least`` or more: the first ``left`` with the others, or, where all
    are ``left``, among each other. Through an inverted index of the hashes."""
    sizes = np.array([len(x) for x in sets])
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    ranked, held = tokens[order], owners[order]
    first = np.searchsorted(ranked, tokens, "left")
    many = np.searchsorted(ranked, tokens, "right") - first
    ends = np.cumsum(sizes)
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, after = [], 0 if left == len(sets) else left
    for i in range(left):
        own = slice(ends[i] - sizes[i], ends[i])
        n, f = many[own], first[own]
        both = np.bincount(held[np.repeat(f - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets)) if len(n) else np.zeros(len(sets), int)
        hits = np.flatnonzero((both >= least * np.sqrt(sizes * float(sizes[i])) - 1e-9) & ((sizes > 0) == (sizes[i] > 0)))  # texts without words are alike
        for j in hits[hits >= max(after, i + 1)].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                out.append((i, j))
    return out


def compared(dealt: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect the sets (root, i, j: the task; chosen, node, shingles) with a similarity of ``least`` or more:
    of each task the chosen with all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, found, left = None, [], [], 0

        def linked() -> pa.RecordBatch:
            pairs = similar(found, left, least)
            return pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in pairs], pa.int64()), pa.array([nodes[b] for _, b in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            for root, i, j, chosen, node, raw in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "chosen", "node", "shingles")), strict=True):
                if key != (root, i, j):
                    if len(nodes) > 1 and left:
                        yield linked()
                    key, nodes, found, left = (root, i, j), [], [], 0
                nodes.append(node)
                found.append(np.frombuffer(raw, np.uint64))
                left += chosen
        if len(nodes) > 1 and left:
            yield linked()

    held = dealt.select("root", "i", "j", "chosen", "node", "shingles").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", F.desc("chosen"), "node")
    return held.mapInArrow(run, "a long, b long")


def verified_links(texts: DataFrame, shingle: int, least: float, plain: bool = False) -> DataFrame:
    """Links (a, b) that connect texts (root: candidate component, node, text) with shingle similarity at ``least`` or more.

    A component of up to ``COMPARED`` texts and ``HELD`` shingles is one task. A larger one is dealt in parts of about so
    many, so that long texts come in parts of fewer, and first each part is compared with the component's ``PIVOTS``. Texts
    that these connect with most of the component need not be compared with each other; only the rest is, in blocks, with all. So a group of near copies, however large, costs a
    multiple of its size where the pivots reach most of it, and no task holds more than two parts.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [shingle_set(x.as_py() or "", shingle, plain) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("node"), pa.array(held, pa.binary())], ["root", "node", "shingles"])

    sets = written(texts.select("root", "node", "text").mapInArrow(made, "root long, node long, shingles binary"), "shingle-sets")
    tasks = lambda texts, size: F.ceil(F.greatest(texts / COMPARED, size / HELD)).cast("int")
    size = (F.length("shingles") / 8).cast("long")
    sizes = written(sets.groupBy("root").agg(tasks(F.count("*"), F.sum(size)).alias("parts")), "component-sizes")
    dealt = sets.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # of a large component the first by node, which is a hash; ranks beyond the number of pivots are cut before the exchange
    first = sets.select("root", "node").join(sizes.where("parts > 1"), "root").withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("node"))).where(F.col("rank") <= PIVOTS)
    pivots = written(first.select("root", "node", F.lit(True).alias("pivot")), "pivots")
    dealt = dealt.join(pivots, ["root", "node"], "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    chosen = F.col("pivot") | (F.col("parts") == 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["root", "node", "shingles", "chosen", "i", "j"]
    # a pivot is chosen in each part's task, and one of the others in its own part's, where it meets the other pivots
    as_chosen = dealt.where(chosen).select("root", "node", "shingles", F.lit(True).alias("chosen"), F.lit(0).alias("i"), every("parts").alias("j"))
    as_other = dealt.where("parts > 1").select("root", "node", "shingles", F.lit(False).alias("chosen"), F.lit(0).alias("i"), F.col("own").alias("j"))
    by_pivots = written(compared(as_chosen.unionByName(as_other), least), "links-of-pivots")
    large = written(sets.select("root", "node", size.alias("size")).join(sizes.where("parts > 1"), "root"), "large-components")
    found = components(by_pivots.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
    grouped = written(large.join(found.withColumnRenamed("root", "sub"), "node", "left").select("root", "node", "size", F.coalesce("sub", "node").alias("sub")), "groups-of-pivots")
    by_sub = grouped.groupBy("root", "sub").agg(F.count("*").alias("count"), F.sum("size").alias("size"))
    most = written(by_sub.groupBy("root").agg(F.max(F.struct("count", "sub", "size")).alias("top"), F.sum("count").alias("all"), F.sum("size").alias("size")), "largest-groups")
    open_ = most.select("root", F.col("top.sub").alias("most"), tasks(F.col("all") - F.col("top.count"), F.col("size") - F.col("top.size")).alias("rest"), tasks(F.col("top.count"), F.col("top.size")).alias("parts")).where("rest > 0")
    placed = grouped.drop("size").join(open_, "root").select("root", "node", "rest", "parts", (F.col("sub") != F.col("most")).alias("left_over"))
    placed = sets.join(placed, ["root", "node"]).withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("left_over"), F.col("rest")).otherwise(F.col("parts"))).cast("int"))
    # blocks of what is left over with each other, and each of them with each part of what is connected
    rest, settled = placed.where("left_over"), placed.where(~F.col("left_over"))
    with_rest = rest.withColumn("other", every("rest")).select("root", "node", "shingles", (F.col("own") <= F.col("other")).alias("chosen"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    with_parts = rest.select("root", "node", "shingles", F.lit(True).alias("chosen"), F.col("own").alias("i"), F.col("rest").alias("__at"), every("parts").alias("j")).withColumn("j", F.col("__at") + F.col("j"))
    as_parts = settled.select("root", "node", "shingles", F.lit(False).alias("chosen"), every("rest").alias("i"), (F.col("rest") + F.col("own")).alias("j"))
    return by_pivots.unionByName(compared(with_rest.select(columns).unionByName(with_parts.select(columns)).unionByName(as_parts.select(columns)), least))


def first_of_each_group(docs: DataFrame, links: Links = WIDE, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each group of texts that links of similarity (cosine of the sets of
    shingles) ``least`` or more connect the row with the least id stays. Fingerprints with BK-trees and rare shared shingles give candidates, the latter every pair
    that can be so similar; shared shingles decide.
    """
    small_batches(docs.sparkSession)
    keyed = docs.withColumn("__did", F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))).withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    texts = keyed.select(F.col("__did").alias("did"), F.col("__hash").alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py(), links.shingle, links.bits, links.once, links.plain) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("hash"), batch.column("digest"), pa.array(made, pa.binary())], ["did", "hash", "digest", "fingerprint"])

    rows = texts.select("did", "hash", F.unhex(F.md5("text")).alias("digest"), "text").mapInArrow(prints, "did long, hash long, digest binary, fingerprint binary")
    classes = written(rows.groupBy("digest").agg(F.min(F.struct("did", "hash")).alias("first"), F.first("fingerprint").alias("fingerprint")).select("first.*", "digest", "fingerprint").withColumn("node", F.xxhash64("digest")), "text-classes")
    nodes = texts.select(F.xxhash64(F.unhex(F.md5("text"))).alias("node"), "text")
    candidates = components(shard_links(classes, widened(links, classes.count())).unionByName(rare_links(nodes, links.shingle, least, links.plain)))
    near = written(classes.join(candidates, "node").select("did", "hash", "node", "root"), "candidates")
    # rows that share id and text are equal: one of them speaks for all
    moved = written(texts.join(near, ["did", "hash"]).dropDuplicates(["node"]).select("root", "node", "text"), "candidate-texts")
    groups = components(verified_links(moved, links.shingle, least, links.plain))
    stay = classes.select("did", "hash", "node").join(groups, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min(F.struct("did", "hash")).alias("first"))
    stay = stay.select(F.col("first.did").alias("__did"), F.col("first.hash").alias("__hash"))
    return keyed.join(stay, ["__did", "__hash"]).dropDuplicates(["__did", "__hash"]).select(*[F.col(c) for c in docs.columns])
