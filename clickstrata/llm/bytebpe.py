"""Byte-level BPE encoding and decoding with a contiguous rank array.

Method: a short word is its part boundaries and, beside them, the merge rank of each part with the next. The least
rank is searched for again and again; its boundary is deleted and the ranks next to it are refreshed. Words over
``LONG`` bytes, where the repeated scan would take the square of their length, keep the same ranks in a heap.

Null texts count as empty: no ids, empty decoded text; null ids are kept. Empty tables give no rows. Repeated rows are
returned each time. Of two places with the least rank the first is merged. A very long text is encoded whole, word by
word; a batch holds at most 16 MB of texts, or one text. Columns besides id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import small_batches

#: White space of the split pattern: Unicode's White_Space property.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the public split pattern of this vocabulary, over any text and, faster, over Latin-1 and Latin Extended-A.
ANY = regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LETTER, DIGIT, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
PLAIN = re.compile(f" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{DIGIT}]+| ?[^{BLANK}{LETTER}{DIGIT}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
UNUSUAL = re.compile("[^\\x00-\\u017f\\u2010-\\u2027\\u20ac]")
#: Words kept per worker, the longest that are, and the longest that are merged by scanning.
KEEP, KEEP_CHARS, LONG = 800_000, 48, 128
NONE = 1 << 60


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies: itself, or the next unused one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        byte = {c: b for b, c in enumerate(byte_symbols())}
        raw = lambda token: bytes(byte[c] for c in token)
        ids = held["model"]["vocab"]
        #: (left id, right id) to (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(held["model"]["merges"]):
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.byte_ids = [ids[c] for c in byte_symbols()]
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.tokens: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in ids.items():
            self.tokens[i] = raw(t)
        for t, i in self.special.items():
            self.tokens[i] = t.encode()
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > LONG:
            return self._merge_long(parts)
        found = self.merges.get
        # ranks[i] joins parts[i] and parts[i + 1]: rank, merged id
        none = (NONE, 0)
        ranks = [found(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none or best[0] == NONE:
                break
            at = ranks.index(best)
            parts[at] = best[1]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = found((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = found((parts[at], parts[at + 1]), none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        found, n = self.merges.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(hit[0], i, parts[i], parts[i + 1], hit[1]) for i in range(n - 1) if (hit := found((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if hit := found((made, parts[k])):
                    heapq.heappush(heap, (hit[0], i, made, parts[k], hit[1]))
            if (h := before[i]) >= 0 and (hit := found((parts[h], made))):
                heapq.heappush(heap, (hit[0], h, parts[h], made, hit[1]))
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> bytes:
        words = (ANY if UNUSUAL.search(text) else PLAIN).findall(text)
        known = self.known
        parts: list = list(map(known.get, words))
        if None in parts:
            gaps, at = [], -1
            for _ in range(parts.count(None)):
                at = parts.index(None, at + 1)
                gaps.append(at)
            made = {w: array("I", self.merge(w.encode())).tobytes() for w in {words[i] for i in gaps}}
            for i in gaps:
                parts[i] = made[words[i]]
            if len(known) + len(made) > KEEP:
                known.clear()
            known.update((w, p) for w, p in made.items() if len(w) <= KEEP_CHARS)
        return b"".join(parts)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids; special strings in the text become their own ids."""
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [self._plain(text[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        out.append(self._plain(text[at:] if at else text))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, array("I", ids))).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    """The worker's own ByteBPE for a vocabulary file; words kept between tasks."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, as binary) and the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            ids = [bpe.encode(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of ``encoded`` taken in the worker, so that ids stay there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            sizes, ids, texts = [], [], []
            for x in batch.column(1):
                held = bpe.encode(x.as_py() or "")
                sizes.append(len(held) // 4)
                ids.append(sha256(held).hexdigest())
                texts.append(sha256(bpe.decode(held).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
