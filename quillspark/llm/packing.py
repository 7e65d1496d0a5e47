"""Packing of documents into training sequences by bounded-space online best-fit.

Each task packs the documents it reads, in the order it reads them, without a shuffle.  It keeps a
fixed number of open sequences in a bitset keyed by free space: the lowest set bit at or above a
piece's length is the tightest sequence it fits.  If none fits and all places are taken, the
fullest open sequence closes first.  So memory does not depend on the input, and what is lost is
the free space of sequences that close and of those still open when a task ends.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytesnp import text_buffer
from quillspark.llm.pretokens import encoder
from quillspark.session import ready

SEQUENCE_BITS = 40  # sequences of one task


class BestFit:
    """place(length) gives (sequence, offset). Lengths are 1 to capacity."""

    def __init__(self, capacity: int, open_limit: int):
        self.capacity, self.open_limit = capacity, open_limit
        self.bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        sequence = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        if not 1 <= length <= self.capacity:
            raise ValueError(f"a piece of {length} in sequences of {self.capacity}")
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            sequence, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if self.open == self.open_limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(sequence)
            self.open += 1
        return sequence, self.capacity - free


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, open_limit: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and end_id (null text: end_id alone). Only documents longer than capacity
    are cut, into pieces of capacity ids and a last one that may be shorter. Repeated rows are packed
    each by itself; null ids stay null; no rows give no rows.
    """
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, bins = encoder(tokenizer), BestFit(capacity, open_limit)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            keys = batch.column(0).to_pylist()
            a = 0
            while a < len(keys):  # about 4 MB of text at a time
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (4 << 20), "right")) - 1)
                ids, counts = enc.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data = memoryview(np.insert(ids, np.cumsum(counts), end_id).astype("<u4").tobytes())
                rows: list[tuple] = []
                at = 0
                for key, n in zip(keys[a:b], (counts + 1).tolist(), strict=True):
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        sequence, offset = bins.place(length)
                        first = 4 * (at + start)
                        rows.append((key, piece, start, length, zlib.crc32(data[first : first + 4 * length]), base + sequence, offset))
                    at += n
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
                a = b

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
