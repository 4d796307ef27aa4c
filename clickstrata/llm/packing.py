"""Best-fit packing of token pieces into sequences of a fixed length.

Method: bounded-space online best-fit. A task holds at most ``open_bins`` open sequences in a bitset keyed by free
space: the lowest set bit at or above a piece's length is the best fit. Where too many are open, the fullest closes.
Pieces reach a task in runs of about ``RUN``, each run longest first: the open sequences then have room for what the
next run brings, and best-fit wastes little though few are open.

Null texts count as empty: one piece that holds the end id alone. Null ids are packed like others. Empty tables give no
rows. Repeated rows are packed once each; which of two equal rows comes first is the same in every try of a task. A very
long text is encoded whole and cut into pieces. Columns besides id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickstrata.llm.common import small_batches, written
from clickstrata.llm.wordbpe import word_tokens

CAPACITY = 2048
#: Open sequences a task holds; pieces that it packs, and pieces of a run, about.
OPEN_BINS, TASK_PIECES, RUN = 1 << 10, 1 << 16, 1 << 12


class OpenBins:
    """The open sequences of one task."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.count, self.made, self.closed, self.free_bits = capacity, limit, 0, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        found = held.pop()
        if not held:
            self.free_bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Sequence number and offset for a piece."""
        if fits := self.free_bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.made
            self.made += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.count += 1
            if self.count > self.limit:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.closed += 1
        return number, self.capacity - free


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of at most ``capacity`` tokens."""
    end = end_id.to_bytes(4, "little")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, size = word_tokens(vocabulary), 4 * capacity
        for batch in batches:
            ids, numbers, starts, lengths, sums = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held = tokens.ids(text.as_py() or "") + end
                for k in range(0, len(held), size):
                    cut = held[k : k + size]
                    ids.append(doc)
                    numbers.append(k // size)
                    starts.append(k // 4)
                    lengths.append(len(cut) // 4)
                    sums.append(zlib.crc32(cut))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_pieces: int = TASK_PIECES) -> DataFrame:
    """pieces (any rows with doc_id, piece and length) with sequence_id and offset; each row keeps its other columns.

    Pieces are dealt evenly by all their values into as many tasks as their count asks for; sequence numbers carry the
    task's number, and the order within a task is total, so that a task that runs again gives the same rows.
    """
    pieces = written(pieces, "pieces")
    number = pieces.count()
    tasks = max(1, math.ceil(number / task_pieces))
    runs = max(1, math.ceil(number / tasks / RUN))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            made = [pa.array([first + n for n, _ in placed], pa.int64()), pa.array([at for _, at in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "sequence_id", "offset"])

    run = F.pmod(F.xxhash64(*pieces.columns), F.lit(runs))
    dealt = pieces.repartition(tasks, *pieces.columns).sortWithinPartitions(run, F.desc("length"), "doc_id", "piece", *[c for c in pieces.columns if c not in ("doc_id", "piece", "length")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.mapInArrow(pack, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit(token_pieces(docs, vocabulary))
