"""Token counts from a tokenizer compiled to a deterministic finite-state transducer.

Byte-pair encoding has a local test: a row of tokens is the encoding of its text
exactly if each token, and each pair of neighbours, is the encoding of its own text.  So
the encoding of a prefix is known from its last token and the encodings of shorter prefixes,
and only prefixes inside the longest suffix that can still begin a token matter.  That
suffix, with the last token and relative count at each place in it, is a state; there are
finitely many.  A transition reads one byte of a pre-token (marked if it is the last) and
emits the change in the number of tokens; a marked byte leads back to the start.
Transitions are compiled when first met, asking the library for the encodings of pairs,
into a table of bounded size that is emptied when full.

Text is cut into chunks of equal length.  A chunk maps the state it is entered in to the state
it is left in and a count.  After its first marked byte this map no longer depends on the entry, so
all chunks are walked side by side from an unknown state, the maps are composed from left to
right, and the heads before the first marked byte are walked side by side from the states found.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.bytesnp import blocks, text_buffer
from quillspark.llm.pretokens import Encoder, byte_letters, cut
from quillspark.session import ready

START, UNKNOWN = 0, 1
#: Beside 256 bytes and 256 marked bytes: the filler after a batch's end, which changes nothing.
PAD = 512
CHUNK = 128
#: Multiplier and shift that spread keys over the table; keys stay below 2^32, so the product fits 63 bits.
SPREAD, SHIFT = 0x4F1BBCDD, 20


class Transducer:
    SLOTS = 1 << 21
    MAX_FILLED = 3 << 18

    def __init__(self, path: str):
        from tokenizers import models

        self.encoder = Encoder(path)
        spec = json.loads(self.encoder.tokenizer.to_str())["model"]
        suffix = spec.get("end_of_word_suffix") or ""
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in spec["vocab"].items():
            ends = bool(suffix) and token.endswith(suffix)
            name = token[: -len(suffix)] if ends else token
            if all(c in byte_of for c in name):
                (self.final if ends else self.inner)[bytes(byte_of[c] for c in name)] = i
        self.inner_model = self.final_model = self.encoder.model
        if suffix:
            self.inner_model = models.BPE(vocab=spec["vocab"], merges=[tuple(m) for m in spec["merges"]])
        else:
            self.final = self.inner
        self.prefixes = {t[:k] for t in (*self.inner, *self.final) for k in range(1, len(t))}
        self.text_of = {i: t for t, i in self.inner.items()}
        self._letters = byte_letters()
        self._fits: dict[tuple, bool] = {}
        self._clear()

    # -- compilation -------------------------------------------------------
    def _clear(self) -> None:
        self.states = [(b"", ((0, -1, 0),)), None]
        self.number = {self.states[START]: START}
        self.keys = np.full(self.SLOTS, -1, np.int64)
        self.cells = np.zeros(self.SLOTS, np.int32)
        self.filled = 0
        for symbol in range(512):
            self._put(UNKNOWN, symbol, START if symbol >= 256 else UNKNOWN, 0)

    def _put(self, state: int, symbol: int, to: int, delta: int) -> None:
        key = state << 10 | symbol
        slot = key * SPREAD >> SHIFT & self.SLOTS - 1
        while self.keys[slot] >= 0:
            slot = slot + 1 & self.SLOTS - 1
        self.keys[slot] = key
        self.cells[slot] = to << 8 | delta + 128
        self.filled += 1
        if 4 * self.filled > 3 * self.SLOTS:  # within one very long text of ever new words
            keys, cells = self.keys, self.cells
            self.SLOTS *= 2
            self.keys, self.cells = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, np.int32)
            for k, c in zip(keys[keys >= 0].tolist(), cells[keys >= 0].tolist(), strict=True):
                slot = k * SPREAD >> SHIFT & self.SLOTS - 1
                while self.keys[slot] >= 0:
                    slot = slot + 1 & self.SLOTS - 1
                self.keys[slot], self.cells[slot] = k, c

    def _fit(self, last: int, token: int, text: bytes, final: bool) -> bool:
        """Whether token may follow last (-1: begins) in an encoding."""
        key = (last, token, final)
        known = self._fits.get(key)
        if known is None:
            model, whole = self.final_model if final else self.inner_model, text if last < 0 else self.text_of[last] + text
            ids = [t.id for t in model.tokenize("".join(map(self._letters.__getitem__, whole)))]
            if len(self._fits) > 1 << 21:
                self._fits.clear()
            known = self._fits[key] = ids == ([token] if last < 0 else [last, token])
        return known

    def _compile(self, state: int, symbol: int) -> None:
        if symbol == PAD:
            return self._put(state, symbol, state, 0)
        final, byte = symbol >= 256, bytes([symbol & 255])
        suffix, cuts = self.states[state]
        grown, vocab = suffix + byte, self.final if final else self.inner
        for k, last, count in cuts:
            text = grown[k:]
            token = vocab.get(text)
            if token is not None and self._fit(last, token, text, final):
                break
        else:
            raise ValueError(f"no encoding of {grown!r}")
        delta = count + 1
        if not -128 <= delta < 128:
            raise OverflowError(f"{delta} tokens at once")
        to = START
        if not final:
            kept = [(k, t, c - delta) for k, t, c in cuts if grown[k:] in self.prefixes]
            k0 = kept[0][0] if kept else len(grown)
            key = (grown[k0:], (*((k - k0, t, c) for k, t, c in kept), (len(grown) - k0, token, 0)))
            to = self.number.get(key, -1)
            if to < 0:
                to = self.number[key] = len(self.states)
                self.states.append(key)
        self._put(state, symbol, to, delta)

    # -- walking -----------------------------------------------------------
    def _find(self, key: np.ndarray) -> np.ndarray:
        """The cell of each key (state << 10 | symbol), or -1."""
        mask = self.SLOTS - 1
        slot = key * SPREAD >> SHIFT & mask
        found = self.keys[slot]
        out = self.cells[slot]
        todo = np.flatnonzero(found != key)
        if len(todo):
            out[todo] = -1
            todo = todo[found[todo] >= 0]
            slot = slot[todo]
            while len(todo):
                slot = slot + 1 & mask
                found = self.keys[slot]
                hit = found == key[todo]
                out[todo[hit]] = self.cells[slot[hit]]
                go = ~hit & (found >= 0)
                todo, slot = todo[go], slot[go]
        return out

    def _step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        key = state << 10 | symbol
        cell = self._find(key)
        if len(cell) and cell.min() < 0:
            for x in np.unique(key[cell < 0]).tolist():
                self._compile(x >> 10, x & 1023)
            cell = self._find(key)
        return cell

    def _walk(self, columns: np.ndarray, state: np.ndarray, emitted: np.ndarray, lanes) -> np.ndarray:
        """Walks lanes over all rows of symbols; emitted gets the counts; returns the last states."""
        for k in range(len(columns)):
            cell = self._step(state, columns[k, lanes])
            emitted[k, lanes] = (cell & 255) - 128
            state = (cell >> 8).astype(np.int64)
        return state

    def emissions(self, symbols: np.ndarray) -> np.ndarray:
        """The change in the number of tokens at each symbol (byte, plus 256 at the end of a pre-token)."""
        n = len(symbols)
        if n == 0:
            return np.zeros(0, np.int64)
        if self.filled > self.MAX_FILLED:
            self._clear()
        lanes = -(-n // CHUNK)
        padded = np.full(lanes * CHUNK, PAD, np.int64)
        padded[:n] = symbols
        columns = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        emitted = np.zeros((CHUNK, lanes), np.int16)
        entry = np.full(lanes, UNKNOWN)
        entry[0] = START
        left = self._walk(columns, entry, emitted, slice(None))
        # compose: chunks without a marked byte wait for the chunk before them
        waits = np.flatnonzero(left == UNKNOWN)
        whole = np.zeros(lanes, bool)
        whole[0] = True
        whole[waits] = True
        while len(waits):
            now = waits[left[waits - 1] != UNKNOWN]
            left[now] = self._walk(columns, left[now - 1], emitted, now)
            waits = waits[left[waits] == UNKNOWN]
        # the heads of the others
        active = np.flatnonzero(~whole)
        state = left[active - 1]
        for k in range(CHUNK):
            if not len(active):
                break
            col = columns[k, active]
            cell = self._step(state, col)
            emitted[k, active] = (cell & 255) - 128
            go = (col < 256) | (col == PAD)
            active, state = active[go], (cell[go] >> 8).astype(np.int64)
        return np.ascontiguousarray(emitted.T).reshape(-1)[:n]

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        enc, out = self.encoder, np.zeros(len(offsets) - 1, np.int64)
        for a, b in blocks(offsets):
            part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            whole = enc._whole(part, off)
            norm, noff = enc.normalised(part, off)
            starts, ends = cut(norm, noff, enc.spaced)
            edge = np.zeros(len(norm) + 1, np.int8)
            edge[starts] += 1
            edge[ends] -= 1
            inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
            symbols = norm.astype(np.int64)
            symbols[ends - 1] += 256
            sums = np.r_[0, np.cumsum(self.emissions(symbols[inside]), dtype=np.int64)]
            places = np.r_[0, np.cumsum(inside)][noff]
            out[a:b] = np.diff(sums[places])
            for i in whole:
                out[a + i] = len(enc.tokenizer.encode(part[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids)
        return out


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null texts count as empty. Repeated rows stay. Only the two named columns are read, so others may have any name.
    """
    ready(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(tokenizer)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            n = t.counts(raw, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
