"""Vectorised work on UTF-8 text: whole Arrow batches as one byte buffer.

A batch of texts is a uint8 buffer plus offsets (null texts have length 0).
Classes, words and hashes are found for all bytes of a block at once; blocks
hold whole texts and about BLOCK bytes, so memory is bounded by BLOCK or by the
longest single text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

#: Odd multipliers and the key of long spans' hashes.
GOLDEN = 0x9E3779B97F4A7C15
LENGTH = 0xD6E8FEB86659FD93
KEY = b"quillspark spans"
#: Spans longer than this are hashed by blake2b, one by one.
LONG = 64
#: Spans that are hashed side by side.
SPANS = 1 << 16
_U = np.uint64


def give_back() -> None:
    """Returns freed memory to the system: the C library and Arrow keep it otherwise, and Spark's workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


#: What a worker keeps for its next task, such as tokenizers with their tables.
kept: dict = {}


def drop_kept() -> None:
    """Frees what is kept. Functions sent to workers call this by name: a dict they refer to would be sent as a copy."""
    if kept:
        kept.clear()
        give_back()


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow whose worker holds no freed memory after its task, and during it nothing that other functions keep from task to task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        yield from run(batches)
        give_back()

    return task


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """uint8 bytes and int64 offsets (n + 1) of an Arrow string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of whole texts with about size bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A uint64 hash of the bytes of each span; equal bytes give equal hashes wherever they lie.

    Eight bytes at a time go through splitmix64's finaliser, which is not linear, so that spans that differ in a pattern do not
    meet as under a polynomial; spans of one length up to eight bytes never meet. Other seeds give other functions.
    """
    starts, n = np.asarray(starts, np.int64), np.asarray(ends, np.int64) - starts
    with np.errstate(over="ignore"):
        h = mix(n.astype(_U) * _U(LENGTH) + _U((seed + 1) * GOLDEN % 2**64))
    if not len(starts) or not len(raw):
        return h
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each place on
    for a in range(0, len(n), SPANS):
        own = n[a : a + SPANS]
        live = np.flatnonzero((own > 0) & (own <= LONG))
        at, left, live = starts[a + live], own[live], a + live
        while len(live):
            v = eights[at]
            short = left < 8
            v[short] &= (_U(1) << (left[short] << 3).astype(_U)) - _U(1)
            h[live] = mix(h[live] ^ v)
            go = left > 8
            live, at, left = live[go], at[go] + 8, left[go] - 8
    key = KEY + seed.to_bytes(8, "little")
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : starts[i] + n[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    return h


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of a word: for "anything but blank" and for "digits, letters a-z and all beyond ASCII".
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def words(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the number of words before each text (n + 1).

    A word is a longest run of bytes with is_word inside one text. raw holds just these texts; offsets[0] is 0.
    """
    if len(raw) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ok = is_word[raw]
    first = ok.copy()
    first[1:] &= ~ok[:-1]
    begins = offsets[:-1]
    begins = begins[begins < len(raw)]
    first[begins] = ok[begins]  # a text's first byte begins a word even if the text before ends in one
    last = np.zeros(len(raw), bool)
    last[:-1] = ok[:-1] & (~ok[1:] | first[1:])
    last[-1] = ok[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def doc_of(bounds: np.ndarray) -> np.ndarray:
    """For items counted by bounds (n + 1), the index of each item's text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width neighbouring word hashes, for each start (len(h) - width + 1, or none)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out = out * _U(0xD1342543DE82EF95) + (h[k : k + n] ^ _U(k * 0x632BE59BD9B4E019 % 2**64))
    return mix(out)


def repeat_ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ... counts[i] of them, for each i in turn."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
