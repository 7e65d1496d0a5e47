"""Texts under zstd for shuffles and files, and a sieve that keeps texts nobody asks for out of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytesnp import tidy

#: Bits of the sieve for ids: 8 MB are broadcast, however many ids are wanted. With more ids more other texts pass, which joins then drop.
SIEVE_BITS = 26
BITMAP_BITS = 15  # of one bitmap_construct_agg


def pack(texts: pa.Array) -> pa.Array:
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    return pa.array([z.compress(t.as_buffer()) for t in texts], pa.binary())


def unpack(column: pa.Array) -> pa.Array:
    import zstandard

    z = zstandard.ZstdDecompressor()
    return pa.array([z.decompress(x.as_buffer()) for x in column], pa.binary()).cast(pa.large_binary()).cast(pa.large_string())


def sieve(places: DataFrame, bits: int) -> np.ndarray:
    """1 << bits bits as bytes, set at the places (column h, from 0); made of at most 1 << bits - BITMAP_BITS rows."""
    marks = places.groupBy(F.shiftright("h", BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("h").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))).alias("bits"))
    out = np.zeros((1 << bits - BITMAP_BITS, 1 << BITMAP_BITS - 3), np.uint8)
    for row in marks.toLocalIterator():
        out[row.bucket] = np.frombuffer(bytes(row.bits), np.uint8)
    return out.ravel()


def passes(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (held[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)


def packed_of(texts: DataFrame, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """(id, packed) of the texts with an id in wanted (id), and of some others: a sieve without a shuffle of texts.
    If not inside, of the texts that do not pass."""
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    held = texts.sparkSession.sparkContext.broadcast(sieve(wanted.select(place.alias("h")), SIEVE_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(np.flatnonzero(passes(held.value, batch.column(2).to_numpy()) == inside))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pack(batch.column(1).take(keep))], names=["id", "packed"])

    return texts.where("text is not null").select("id", "text", place.alias("h")).mapInArrow(tidy(run), "id long, packed binary")
