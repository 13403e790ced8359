"""Best-fit packing of tokenized documents into sequences of at most CAPACITY tokens.

A document is its ids and an end id. Only documents longer than a sequence are cut, into full pieces and a rest. Pieces
are dealt to groups of about GROUP_DOCS documents; each group is packed online, in arrival order (the order of the
table's rows), by bounded-space best-fit: at most OPEN bins are open, one bit of an integer stands for each amount of
free space that an open bin has, so the tightest bin that still fits is found by masking; when a bin too many is open,
the fullest closes for good. A task holds the open bins of one group and nothing else, however many pieces it gets.

Defined results: null or empty text is one piece, the end id. Rows that repeat, rows without a doc_id and equal texts are
packed each on its own, and are dealt over all groups. No rows give no pieces. A rerun of a lost task repeats the same
choices, as a row's arrival number is its place in its input split. Other columns of docs aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import runtime, tokens

CAPACITY = 2048
#: Bins that are open at once; the next one closes the fullest.
OPEN = 128
#: Documents for each group that is packed on its own.
GROUP_DOCS = 16_384
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class BestFit:
    """Bounded-space online best-fit: place() gives a bin and the offset in it."""

    def __init__(self, capacity: int = CAPACITY, most_open: int = OPEN):
        self.capacity, self.most, self.bits, self.open, self.made, self.closed = capacity, most_open, 0, 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        own = self.bins[free]
        b = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.open -= 1
        return b

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            b, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.bins[left].append(b)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
        return b, self.capacity - free


def cut_pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with the crc32 of its ids and its arrival number: input split, then place in it."""

    def cut(batches):
        came = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, buf, offs in K.slices(batch.column(1)):
                ids, at = tokens.with_end(*tokens.table(path).encode(buf, offs), end_id)
                n = np.diff(at)
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                lo = at[row] + start
                crc = [tokens.crc32(ids[i:j]) for i, j in zip(lo, lo + length, strict=True)]
                arrival = came + np.arange(len(row))
                came += len(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(arrival)], names=["doc_id", "piece", "start", "length", "ids_crc32", "arrival"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, _PIECES + ", arrival long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, most_open: int = OPEN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of docs (doc_id, text)."""
    runtime.ship(docs.sparkSession)
    groups = max(1, math.ceil(docs.count() / GROUP_DOCS))
    pieces = cut_pieces(docs, path or tokens.vocabulary_path(), capacity, end_id).withColumn("g", F.expr(f"pmod(xxhash64(arrival), {groups})"))

    def pack(batches):
        # rows come sorted by group and arrival: a task holds one group's open bins
        now, fit = None, None
        for batch in batches:
            groups, lengths = batch.column("g").to_pylist(), batch.column("length").to_pylist()
            ids, offsets = [], []
            for g, length in zip(groups, lengths, strict=True):
                if g != now:
                    now, fit = g, BestFit(capacity, most_open)
                b, at = fit.place(length)
                ids.append((g << 40) + b)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], names=[*batch.schema.names[:-2], "sequence_id", "offset"])

    return pieces.repartition("g").sortWithinPartitions("g", "arrival").mapInArrow(pack, _PIECES + ", sequence_id long, offset long")
