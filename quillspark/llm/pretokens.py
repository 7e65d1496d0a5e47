"""Cuts text into the pre-tokens of a tokenizers file and encodes each distinct one by the library once.

A byte-pair tokenizer encodes its pre-tokens one by one, so the ids of a text are
the ids of its pre-tokens in order.  The library encodes about half a megabyte a
second; cutting with numpy and encoding only distinct pre-tokens is some ten times as fast
and gives the same ids.  Texts that need more than that (added tokens inside the
text) go through the library whole.

Two kinds of file are read: byte-level BPE whose pre-tokens keep one leading space,
and BPE with word ends over NFC, white space collapsed, lower case.  The classes of
code points come from the library's own regular expressions.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np

from quillspark.llm.bytesnp import blocks, kept, repeat_ranges, span_hashes

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Endings after an apostrophe that both files' patterns keep as one pre-token.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: From here on NFC may change a text; below it every text is in NFC already.
FIRST_COMBINING = 0x300


@functools.cache
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """First code points of runs of one class, and their classes, as the library's regular expressions see them."""
    from tokenizers import Regex, pre_tokenizers

    # planes 4 to 13 and the private planes hold no letter, number or space
    chars = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000))]
    table = np.full(0x110000, OTHER, np.uint8)
    codes = np.array([ord(c) for c in chars], np.int64)
    text = "".join(chars)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text):
            table[codes[a:b]] = kind
    first = np.flatnonzero(np.r_[True, table[1:] != table[:-1]])
    return first, table[first]


@functools.cache
def _class_table() -> np.ndarray:
    first, kinds = class_runs()
    return np.repeat(kinds, np.diff(np.r_[first, 0x110000]))


@functools.cache
def _lower_table() -> tuple[np.ndarray, np.ndarray]:
    """For code points below FIRST_COMBINING: the lower-case code point, and whether that is one of as many bytes."""
    low, same = np.arange(FIRST_COMBINING), np.ones(FIRST_COMBINING, bool)
    for c in range(FIRST_COMBINING):
        x = chr(c).lower()
        same[c] = len(x) == 1 and len(x.encode()) == len(chr(c).encode())
        if same[c]:
            low[c] = ord(x)
    return low, same


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, code points and byte lengths of the characters beyond ASCII."""
    lead = np.flatnonzero(raw >= 0xC0)
    b0 = raw[lead].astype(np.int64)
    n = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
    cp = np.where(n == 2, b0 & 0x1F, np.where(n == 3, b0 & 0x0F, b0 & 0x07))
    for k in (1, 2, 3):
        more = n > k
        cp[more] = cp[more] << 6 | raw[lead[more] + k] & 0x3F
    return lead, cp, n


def classes(raw: np.ndarray) -> np.ndarray:
    """The class of each byte's character."""
    out = _class_table()[:256][raw]
    lead, cp, n = code_points(raw)
    if len(lead):
        kind = _class_table()[cp]
        for k in range(4):
            more = n > k
            out[lead[more] + k] = kind[more]
    return out


def contraction_lengths(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For apostrophes at the given positions (texts end at end): bytes of the ending after each, 0 if none."""
    out = np.zeros(len(at), np.int64)
    padded = np.r_[raw, np.zeros(2, np.uint8)]
    one, two = padded[at + 1], padded[at + 2]
    for e in reversed(CONTRACTIONS):  # the endings begin with different letters, so their order is of no matter
        fits = (one == e[0]) & (at + len(e) < end)
        if len(e) == 2:
            fits &= two == e[1]
        out[fits] = len(e)
    return out


def cut(raw: np.ndarray, offsets: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all pre-tokens. spaced: pre-tokens keep a leading space, white space is kept, and digits
    stand together; otherwise white space goes and each digit stands alone."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    kind = classes(raw)
    head = (raw & 0xC0) != 0x80  # first byte of a character
    text_start = np.zeros(n + 1, bool)
    text_start[offsets] = True
    start = np.zeros(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= text_start[:n]
    if not spaced:
        start |= (kind == NUMBER) & head
    # contractions: a lone apostrophe that begins a run of its class
    nxt = np.r_[start[1:], True]
    quote = np.flatnonzero((raw == 0x27) & start & nxt)
    if spaced and len(quote):
        quote = quote[(quote == 0) | (raw[quote - 1] != 0x20) | text_start[quote]]
    fixed_end = np.zeros(0, np.int64)
    if len(quote):
        ends = offsets[np.searchsorted(offsets, quote, "right")]
        m = contraction_lengths(raw, quote, ends)
        quote, m, ends = quote[m > 0], m[m > 0], ends[m > 0]
        start[quote + 1] = False
        fixed_end = quote + 1 + m
        inside = fixed_end < n
        start[fixed_end[inside]] = True
    if spaced:
        # the last character of a run of white space leaves the run if another character follows
        run = np.flatnonzero(start)
        run_end = np.r_[run[1:], n]
        blank = (kind[run] == SPACE) & (run_end < n) & ~text_start[run_end]
        e = run_end[blank]
        last = e - 1
        while True:
            back = ~head[last]
            if not back.any():
                break
            last = last - back
        start[last] = True
        start[e[raw[last] == 0x20]] = False  # a space joins what follows
        starts = np.flatnonzero(start)
        return starts, np.r_[starts[1:], n]
    starts = np.flatnonzero(start)
    ends = np.r_[starts[1:], n]
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


@functools.cache
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [""] * 256
    for b in shown:
        out[b] = chr(b)
    for k, b in enumerate(x for x in range(256) if not out[x]):
        out[b] = chr(256 + k)
    return out


def as_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(dict(enumerate(byte_letters())))


class Encoder:
    """Ids of whole texts. Distinct pre-tokens are kept in a hash table of bounded size, emptied when half full."""

    SLOTS = 1 << 21

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix") or ""
        kinds = [(spec.get("pre_tokenizer") or {}).get("type"), (spec.get("normalizer") or {}).get("type")]
        #: Other kinds of tokenizer encode whole texts.
        self.known = spec["model"]["type"] == "BPE" and kinds in (["ByteLevel", None], ["Sequence", "Sequence"]) and bool(suffix) == (kinds[0] == "Sequence")
        self.spaced = not suffix
        self.added = [x["content"].encode() for x in spec["added_tokens"]]
        self.model = self.tokenizer.model
        self._letters = dict(enumerate(byte_letters()))
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.slot_at = np.zeros(self.SLOTS, np.int32)
        self.slot_n = np.zeros(self.SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.pool_n = self.filled = 0

    # -- normalisation -----------------------------------------------------
    def normalised(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes as the file's normaliser leaves them, but for runs of white space, which later steps drop."""
        if self.spaced:
            return raw, offsets
        raw = raw.copy()
        raw[(raw >= 65) & (raw <= 90)] += 32
        lead, cp, n = code_points(raw)
        if not len(lead):
            return raw, offsets
        low, same = _lower_table()
        easy = cp < FIRST_COMBINING
        easy[easy] = same[cp[easy]]
        a, c = lead[easy], low[cp[easy]]
        raw[a], raw[a + 1] = 0xC0 | c >> 6, 0x80 | c & 0x3F
        if easy.all():
            return raw, offsets
        hard = np.unique(np.searchsorted(offsets, lead[~easy], "right") - 1)
        parts, sizes, at = [], np.diff(offsets), 0
        sizes = sizes.copy()
        for i in hard:
            a, b = offsets[i], offsets[i + 1]
            new = self.tokenizer.normalizer.normalize_str(raw[a:b].tobytes().decode()).encode()
            parts += [raw[at:a], np.frombuffer(new, np.uint8)]
            sizes[i], at = len(new), b
        parts.append(raw[at:])
        return np.concatenate(parts), np.r_[0, np.cumsum(sizes)]

    # -- encoding ----------------------------------------------------------
    def _slots(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each pre-token, known by two hashes of 64 bits, or -1."""
        mask = self.SLOTS - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        out = np.full(len(h), -1)
        todo = np.arange(len(h))
        while len(todo):
            found = self.keys[slot]
            same = (found == h[todo]) & (self.checks[slot] == check[todo])
            out[todo[same]] = slot[same]
            go = ~same & (found != 0)
            todo, slot = todo[go], (slot[go] + 1) & mask
        return out

    def _learn(self, raw: np.ndarray, h: np.ndarray, check: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        mask, letters, tokenize, keys = self.SLOTS - 1, self._letters, self.model.tokenize, self.keys
        order = np.lexsort((check, h))
        first = order[np.r_[True, (h[order[1:]] != h[order[:-1]]) | (check[order[1:]] != check[order[:-1]])]]
        hashes, checks = h[first], check[first].tolist()
        data, new = raw.tobytes(), []
        at = self.pool_n
        for x, y, a, b in zip(hashes.tolist(), checks, starts[first].tolist(), ends[first].tolist(), strict=True):
            ids = [t.id for t in tokenize(data[a:b].decode("latin-1").translate(letters))]
            slot = x & mask
            while keys[slot]:
                slot = (slot + 1) & mask
            keys[slot], self.checks[slot] = x, y
            self.slot_at[slot], self.slot_n[slot] = at, len(ids)
            at += len(ids)
            new += ids
        if at > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(max(len(self.pool), at), np.uint32)]
        self.pool[self.pool_n : at] = new
        self.pool_n = at
        self.filled += len(hashes)

    def _block(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = self.normalised(raw, offsets)
        starts, ends = cut(raw, offsets, self.spaced)
        h = span_hashes(raw, starts, ends)
        h[h == 0] = 1
        check = span_hashes(raw, starts, ends, 1)
        slot = self._slots(h, check)
        miss = slot < 0
        if miss.any():
            if self.filled + miss.sum() > self.SLOTS // 2:
                self._clear()
                miss[:] = True
            while 4 * len(starts) > self.SLOTS:  # one long text may hold more than the table
                self.SLOTS *= 2
                self._clear()
                miss[:] = True
            self._learn(raw, h[miss], check[miss], starts[miss], ends[miss])
            slot = self._slots(h, check)
        counts = self.slot_n[slot].astype(np.int64)
        ids = self.pool[repeat_ranges(self.slot_at[slot].astype(np.int64), counts)]
        sums = np.r_[0, np.cumsum(counts)]
        return ids, np.diff(sums[np.searchsorted(starts, offsets, "left")])

    def _whole(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that hold an added token's string; all of them for kinds of tokenizer not known here."""
        if not self.known:
            return np.arange(len(offsets) - 1)
        data = raw.tobytes()
        found = []
        for x in self.added:
            at = data.find(x)
            while at >= 0:
                found.append(at)
                at = data.find(x, at + 1)
        if not found:
            return np.zeros(0, np.int64)
        return np.unique(np.searchsorted(offsets, np.array(found), "right") - 1)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts one after the other, and the number of ids of each text."""
        all_ids, all_counts = [], []
        for a, b in blocks(offsets):
            part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            whole = self._whole(part, off)
            at = 0
            for i in [*whole.tolist(), b - a]:
                if i > at:
                    ids, counts = self._block(part[off[at] : off[i]], off[at : i + 1] - off[at])
                    all_ids.append(ids)
                    all_counts.append(counts)
                if i < b - a:
                    ids = np.array(self.tokenizer.encode(part[off[i] : off[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                    all_ids.append(ids)
                    all_counts.append(np.array([len(ids)], np.int64))
                at = i + 1
        if not all_ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(all_ids), np.concatenate(all_counts)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a file, kept until a task under tidy() runs in the worker."""
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
