"""Token ids as wavelet matrices, one compressed file per shard.

A wavelet matrix keeps one bit-plane per bit of the ids, highest bit first; each
plane is followed by a stable partition of the ids by that bit.  With counts of
ones per 512 bits, any id can be read, any id counted before a place, and its
k-th occurrence found, from the file alone.

File: ``QWM1``, the header's length (4 bytes, little-endian), the header (JSON),
then zstd frames: ids, null flags and lengths of the documents, then for each plane its bits
(little bit order) and its counts.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.bytesnp import text_buffer
from quillspark.llm.pretokens import encoder
from quillspark.session import new_path, ready, written

MAGIC = b"QWM1"
RANK_BITS = 512
SHARD_TOKENS = 1 << 23


class WaveletMatrix:
    """n ids of `levels` bits: planes of packed bits, zeros per plane, and ones before each RANK_BITS bits."""

    def __init__(self, n: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        levels = max(1, int(ids.max()).bit_length()) if n else 1
        cur = ids.astype(np.uint16 if levels <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for shift in range(levels - 1, -1, -1):
            bit = (cur >> shift & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            pad = -len(packed) % (RANK_BITS // 8)
            ones = np.bitwise_count(np.r_[packed, np.zeros(pad, np.uint8)].reshape(-1, RANK_BITS // 8)).sum(1)
            planes.append(packed)
            ranks.append(np.r_[0, np.cumsum(ones)].astype(np.uint32))
            low = cur[~bit]
            zeros.append(len(low))
            cur = np.concatenate([low, cur[bit]])
        return cls(n, zeros, planes, ranks)

    @property
    def levels(self) -> int:
        return len(self.planes)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.planes[level][at >> 3] >> (at & 7).astype(np.uint8) & 1

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place 0..n."""
        block = at // RANK_BITS
        out = self.ranks[level][block].astype(np.int64)
        width = RANK_BITS // 8
        plane = self.planes[level]
        cols = block[:, None] * width + np.arange(width)
        part = plane[np.minimum(cols, max(len(plane) - 1, 0))]
        full = (at >> 3)[:, None]
        part = np.where(cols < full, part, np.where(cols == full, part & ((1 << (at & 7)) - 1).astype(np.uint8)[:, None], 0))
        part[cols >= len(plane)] = 0
        return out + np.bitwise_count(part).sum(1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """The ids at the given places."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the shard")
        out = np.zeros(len(at), np.uint32)
        for k in range(self.levels):
            bit = self._bit(k, at).astype(bool)
            ones = self._ones(k, at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, at: int) -> tuple[int, int]:
        a, b = 0, at
        for k in range(self.levels):
            one = self._ones(k, np.array([a, b]))
            if token >> (self.levels - 1 - k) & 1:
                a, b = self.zeros[k] + int(one[0]), self.zeros[k] + int(one[1])
            else:
                a, b = a - int(one[0]), b - int(one[1])
        return a, b

    def rank(self, token: int, at: int) -> int:
        """How often token stands before place at."""
        if token < 0 or token >> self.levels or at <= 0:
            return 0
        a, b = self._range(token, min(at, self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of token, or -1."""
        if k < 0 or k >= self.count(token):
            return -1
        at = self._range(token, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            want = at - self.zeros[level] if one else at  # the want-th one, or zero, of this plane
            lo, hi = 0, self.n
            while lo < hi:
                mid = (lo + hi) // 2
                ones = int(self._ones(level, np.array([mid + 1]))[0])
                if (ones if one else mid + 1 - ones) > want:
                    hi = mid
                else:
                    lo = mid + 1
            at = lo
        return at

    def occurrences(self, token: int) -> np.ndarray:
        """All places of token, ascending."""
        return np.array([self.select(token, k) for k in range(self.count(token))], np.int64)

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        cur = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for k in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            cur[self.zeros[k] :] |= 1 << (self.levels - 1 - k)
            up = np.empty_like(cur)
            up[~bit] = cur[: self.zeros[k]]
            up[bit] = cur[self.zeros[k] :]
            cur = up
        return cur.astype(np.uint32)


def to_bytes(matrix: WaveletMatrix, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray) -> bytes:
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    frames = [z.compress(np.ascontiguousarray(x).tobytes()) for x in (doc_ids.astype("<i8"), nulls.astype("u1"), lengths.astype("<i8"))]
    for plane, ranks in zip(matrix.planes, matrix.ranks, strict=True):
        frames += [z.compress(plane.tobytes()), z.compress(ranks.astype("<u4").tobytes())]
    head = json.dumps({"n": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "frames": [len(x) for x in frames]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *frames])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, and the documents' ids, null flags and lengths."""
    import zstandard

    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix file")
    size = struct.unpack("<I", data[4:8])[0]
    head, at, z, frames = json.loads(data[8 : 8 + size]), 8 + size, zstandard.ZstdDecompressor(), []
    for n in head["frames"]:
        frames.append(z.decompress(data[at : at + n]))
        at += n
    ids, nulls, lengths = (np.frombuffer(f, t) for f, t in zip(frames, ("<i8", "u1", "<i8"), strict=False))
    planes = [np.frombuffer(f, np.uint8) for f in frames[3::2]]
    ranks = [np.frombuffer(f, "<u4") for f in frames[4::2]]
    return WaveletMatrix(head["n"], head["zeros"], planes, ranks), ids, nulls, lengths


def _put(uri: str, data: bytes) -> None:
    """Writes a file whole under its name: a repeated task replaces it by the same bytes."""
    import os
    import uuid

    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(os.path.dirname(path), recursive=True)
    part = f"{os.path.dirname(path)}/_{uuid.uuid4().hex}"
    with where.open_output_stream(part) as out:
        out.write(data)
    where.move(part, path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every whole text, appends end_id, and writes the ids in ascending id order as files
    ``folder/part-PPPPPP-SSSSSS.qwm``. Returns the written manifest: part, shard, start (ids of the part before it), n_docs, n_tokens.

    Null texts are empty; null ids come first; rows with equal ids stand in the order of their texts.
    No rows: no files. A shard closes after shard_tokens ids, so one holds a document's whole ids at least.
    """
    ready(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard, start = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        n_held = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, start, held, n_held
            keys, nulls, lengths, ids = (np.concatenate([h[k] for h in held]) for k in range(4))
            _put(f"{folder}/part-{part:06d}-{shard:06d}.qwm", to_bytes(WaveletMatrix.of(ids), keys, nulls, lengths))
            out = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "start": [start], "n_docs": [len(keys)], "n_tokens": [len(ids)]})
            shard, start, held, n_held = shard + 1, start + len(ids), [], 0
            return out

        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            keys = batch.column(0)
            nulls = np.asarray(keys.is_null())
            keys = keys.fill_null(0).to_numpy(zero_copy_only=False)
            a = 0
            while a < len(keys):  # about 4 MB of text at a time
                b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (4 << 20), "right")) - 1)
                ids, counts = enc.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, np.cumsum(counts), end_id).astype(np.uint16 if enc.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
                held.append((keys[a:b], nulls[a:b], counts + 1, ids))
                n_held += len(ids)
                if n_held >= shard_tokens:
                    yield close()
                a = b
        if held:
            yield close()

    return written(d.mapInArrow(write, "part long, shard long, start long, n_docs long, n_tokens long"), "shards")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 and ids (binary, little-endian uint32) are all derived
    from the files; the manifest only gives each part's first place."""
    spark = manifest.sparkSession
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each partition of the writing job
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    local = manifest.select("part", "shard", F.col("start").alias("shard_start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                matrix, keys, nulls, lengths = from_bytes(content.as_buffer().to_pybytes())
                ids = matrix.decode()
                ends = np.cumsum(lengths)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                part, shard = (int(x) for x in path.as_py().rsplit("/", 1)[1][5:-4].split("-"))
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.full(n, shard)), pa.array(keys.astype(np.int64), mask=nulls.astype(bool)), pa.array((ends - lengths).astype(np.int64)), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    if not manifest.take(1):
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.qwm").load(folder).select("path", "content")
    rows = files.mapInArrow(read, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    rows = rows.join(F.broadcast(base), "part").join(local, ["part", "shard"])
    return rows.select("doc_id", (F.col("base") + F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, **options) -> DataFrame:
    """Writes the documents' ids as wavelet-matrix files and returns what is read back from them."""
    folder = folder or new_path(ready(docs.sparkSession), "wavelet")
    return read_shards(write_shards(docs, tokenizer, folder, end_id, **options), folder)


def open_file(data: bytes | io.BufferedIOBase) -> WaveletMatrix:
    return from_bytes(data if isinstance(data, bytes) else data.read())[0]
