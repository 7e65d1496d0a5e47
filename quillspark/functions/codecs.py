"""Integer codecs, order-preserving keys, checksums, Bloom filters and run-length coding.

Each codec is a pair of plain functions on lists or bytes; column_codec() makes one a pandas function on columns.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F


def varint_encode(values: list[int]) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    out = bytearray()
    for v in values:
        if v < 0:
            raise ValueError("unsigned values only")
        while v > 0x7F:
            out.append(v & 0x7F | 0x80)
            v >>= 7
        out.append(v)
    return bytes(out)


def varint_decode(data: bytes) -> list[int]:
    out, v, shift = [], 0, 0
    for b in data:
        v |= (b & 0x7F) << shift
        shift += 7
        if not b & 0x80:
            out.append(v)
            v = shift = 0
    if shift:
        raise ValueError("cut off inside a value")
    return out


def zigzag(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def unzigzag(v: int) -> int:
    return v >> 1 if not v & 1 else -(v + 1 >> 1)


def delta_encode(values: list[int]) -> list[int]:
    if any(b < a for a, b in zip(values, values[1:], strict=False)):
        raise ValueError("values must ascend")
    return [b - a for a, b in zip([0, *values], values, strict=False)]


def delta_decode(gaps: list[int]) -> list[int]:
    out, total = [], 0
    for g in gaps:
        total += g
        out.append(total)
    return out


#: How many values of how many bits each selector of a 32-bit word holds.
SIMPLE9 = ((28, 1), (14, 2), (9, 3), (7, 4), (5, 5), (4, 7), (3, 9), (2, 14), (1, 28))


def simple9_encode(values: list[int]) -> list[int]:
    """Words of a 4-bit selector and 28 bits; a word takes as many values as fit, and the end is filled with zeros."""
    out, at = [], 0
    while at < len(values):
        for selector, (n, bits) in enumerate(SIMPLE9):
            part = values[at : at + n]
            if all(0 <= v < 1 << bits for v in part) and (len(part) == n or at + len(part) == len(values)):
                out.append(selector << 28 | sum(v << bits * k for k, v in enumerate(part)))
                at += len(part)
                break
        else:
            raise ValueError("values need at most 28 bits")
    return out


def simple9_decode(words: list[int], count: int) -> list[int]:
    out: list[int] = []
    for w in words:
        n, bits = SIMPLE9[w >> 28]
        out += [w >> bits * k & (1 << bits) - 1 for k in range(n)]
    return out[:count]


def _bits_to_bytes(bits: str) -> bytes:
    bits += "0" * (-len(bits) % 8)
    return int(bits or "0", 2).to_bytes(len(bits) // 8)


def _bits(data: bytes) -> str:
    return f"{int.from_bytes(data):0{8 * len(data)}b}" if data else ""


def gamma_encode(values: list[int]) -> tuple[bytes, int]:
    """Elias gamma codes and their number of bits; values from 1."""
    if any(v < 1 for v in values):
        raise ValueError("values from 1")
    bits = "".join("0" * (v.bit_length() - 1) + f"{v:b}" for v in values)
    return _bits_to_bytes(bits), len(bits)


def gamma_decode(data: bytes, n_bits: int) -> list[int]:
    bits, at, out = _bits(data)[:n_bits], 0, []
    while at < len(bits):
        one = bits.index("1", at)
        end = 2 * one - at + 1
        out.append(int(bits[one:end], 2))
        at = end
    return out


def delta_code_encode(values: list[int]) -> tuple[bytes, int]:
    """Elias delta codes: the length by gamma, then the value without its first bit."""
    if any(v < 1 for v in values):
        raise ValueError("values from 1")
    parts = []
    for v in values:
        n = v.bit_length()
        parts.append("0" * (n.bit_length() - 1) + f"{n:b}" + f"{v:b}"[1:])
    bits = "".join(parts)
    return _bits_to_bytes(bits), len(bits)


def delta_code_decode(data: bytes, n_bits: int) -> list[int]:
    bits, at, out = _bits(data)[:n_bits], 0, []
    while at < len(bits):
        one = bits.index("1", at)
        start = 2 * one - at + 1
        n = int(bits[one:start], 2)
        out.append(int("1" + bits[start : start + n - 1], 2))
        at = start + n - 1
    return out


def rice_encode(values: list[int], k: int) -> tuple[bytes, int]:
    """Quotient by 2^k in ones and a zero, then k bits. Whole bytes of ones are written as such, so a large quotient costs little more than its bytes."""
    out, open_bits = bytearray(), ""
    n_bits = 0
    for v in values:
        ones, rest = v >> k, v & (1 << k) - 1
        n_bits += ones + 1 + k
        first = min(ones, -len(open_bits) % 8)
        whole, last = divmod(ones - first, 8)
        open_bits += "1" * first
        if whole:
            out += int(open_bits, 2).to_bytes(len(open_bits) // 8) if open_bits else b""
            out += b"\xff" * whole
            open_bits = ""
        open_bits += "1" * last + "0" + (f"{rest:0{k}b}" if k else "")
        if len(open_bits) >= 8:
            full = len(open_bits) // 8 * 8
            out += int(open_bits[:full], 2).to_bytes(full // 8)
            open_bits = open_bits[full:]
    return bytes(out) + _bits_to_bytes(open_bits), n_bits


_ONES = re.compile(rb"\xff*")


def rice_decode(data: bytes, n_bits: int, k: int) -> list[int]:
    out, at = [], 0
    while at < n_bits:
        byte, inside = divmod(at, 8)
        ones = min(8 - inside, 8 - ((data[byte] << inside & 0xFF) ^ 0xFF).bit_length())
        if inside + ones == 8:
            end = _ONES.match(data, byte + 1).end()
            ones += 8 * (end - byte - 1)
            ones += 8 - (data[end] ^ 0xFF).bit_length()
        at += ones + 1 + k
        if k:
            first, last = (at - k) // 8, (at + 7) // 8
            low = int.from_bytes(data[first:last]) >> 8 * last - at & (1 << k) - 1
            out.append(ones << k | low)
        else:
            out.append(ones)
    return out


def rice_parameter(mean_gap: float) -> int:
    return max(0, math.ceil(math.log2(mean_gap * math.log(2)))) if mean_gap * math.log(2) > 1 else 0


def rle_encode(data: bytes) -> bytes:
    """Pairs of a run's length (1 to 255) and its byte; no input is lost."""
    out, at = bytearray(), 0
    while at < len(data):
        n = 1
        while n < 255 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        out += bytes((n, data[at]))
        at += n
    return bytes(out)


def rle_decode(data: bytes) -> bytes:
    return b"".join(data[i + 1 : i + 2] * data[i] for i in range(0, len(data), 2))


def ordered_int(v: int, bits: int = 32) -> bytes:
    return v.to_bytes(bits // 8, "big")


def composite_key(*parts: int | str | bytes) -> bytes:
    """Bytes that sort as the tuples of parts do: 0x00 becomes 0x00 0xFF inside a part, and 0x00 0x00 ends it."""
    out = bytearray()
    for p in parts:
        raw = ordered_int(p) if isinstance(p, int) else p.encode() if isinstance(p, str) else p
        out += raw.replace(b"\x00", b"\x00\xff") + b"\x00\x00"
    return bytes(out)


def shared_prefix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _crc_table(poly: int) -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (poly if c & 1 else 0)
        out.append(c)
    return out


_CRC32C = _crc_table(0x82F63B78)


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C (Castagnoli); crc continues an earlier one."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = crc >> 8 ^ _CRC32C[(crc ^ b) & 0xFF]
    return crc ^ 0xFFFFFFFF


def envelope_encode(timestamp: int, key: bytes, value: bytes, headers: bytes = b"") -> bytes:
    """A record: magic, timestamp (8 bytes, big-endian), key, value and headers with varint lengths, CRC-32C."""
    body = b"\x02" + struct.pack(">q", timestamp) + b"".join(varint_encode([len(x)]) + x for x in (key, value, headers))
    return body + struct.pack(">I", crc32c(body))


def envelope_decode(data: bytes) -> tuple[int, bytes, bytes, bytes]:
    body, crc = data[:-4], struct.unpack(">I", data[-4:])[0]
    if body[:1] != b"\x02" or crc32c(body) != crc:
        raise ValueError("not a whole record")
    at, parts = 9, []
    for _ in range(3):
        end = at
        while body[end] & 0x80:
            end += 1
        n = varint_decode(body[at : end + 1])[0]
        parts.append(body[end + 1 : end + 1 + n])
        at = end + 1 + n
    return struct.unpack(">q", body[1:9])[0], *parts


class Bloom:
    """n_bits with k hashes (two, added up)."""

    def __init__(self, n_bits: int = 1024, k: int = 4):
        self.n, self.k, self.bits = n_bits, k, 0

    def _places(self, key: bytes):
        import hashlib

        d = hashlib.blake2b(key, digest_size=16).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return [(a + i * b) % self.n for i in range(self.k)]

    def add(self, key: bytes) -> None:
        for p in self._places(key):
            self.bits |= 1 << p

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits >> p & 1 for p in self._places(key))


def ring_hash(text: str) -> int:
    """FNV-1a of the bytes, then the 32-bit Murmur finaliser."""
    h = 0x811C9DC5
    for b in text.encode():
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    return h ^ h >> 16


def column_codec(f: Callable, kind: str):
    """A pandas function of one column from a plain function; null stays null."""

    @F.pandas_udf(kind)
    def g(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else f(x.tolist() if hasattr(x, "tolist") else x))

    return g


def compression_ratio(raw: int, packed: int) -> float:
    """Raw over packed size; 0 if nothing is left."""
    return raw / packed if packed else 0.0


#: Codes of compression kinds, and of request kinds with their highest versions.
COMPRESSIONS = {0: "none", 1: "gzip", 2: "snappy", 3: "lz4"}
REQUESTS = {0: ("produce", 3), 1: ("fetch", 4), 2: ("list_offsets", 1), 3: ("metadata", 1), 8: ("offset_commit", 2), 9: ("offset_fetch", 2), 18: ("api_versions", 1)}


def supports(kind: int, version: int) -> bool:
    return kind in REQUESTS and 0 <= version <= REQUESTS[kind][1]


def message_set_encode(base: int, records: list[tuple[int, bytes, bytes]]) -> bytes:
    """Records (timestamp, key, value) with a base offset: base (8 bytes), their number (4), then each record's length (4) and envelope."""
    parts = [struct.pack(">qI", base, len(records))]
    for ts, key, value in records:
        body = envelope_encode(ts, key, value)
        parts += [struct.pack(">I", len(body)), body]
    return b"".join(parts)


def message_set_decode(data: bytes) -> tuple[int, list[tuple[int, bytes, bytes]]]:
    base, n = struct.unpack_from(">qI", data)
    at, out = 12, []
    for _ in range(n):
        size = struct.unpack_from(">I", data, at)[0]
        out.append(envelope_decode(data[at + 4 : at + 4 + size])[:3])
        at += 4 + size
    return base, out


def request_encode(kind: int, version: int, correlation: int, client: str, body: bytes) -> bytes:
    """A framed request: length (4), kind (2), version (2), correlation (4), client's name with its length (2), body. All big-endian."""
    if not supports(kind, version):
        raise ValueError(f"request {kind} version {version}")
    name = client.encode()
    head = struct.pack(">hhih", kind, version, correlation, len(name)) + name
    return struct.pack(">I", len(head) + len(body)) + head + body


def request_decode(data: bytes) -> tuple[int, int, int, str, bytes]:
    if len(data) < 14 or struct.unpack_from(">I", data)[0] != len(data) - 4:
        raise ValueError("not a whole request")
    kind, version, correlation, n = struct.unpack_from(">hhih", data, 4)
    return kind, version, correlation, data[14 : 14 + n].decode(), data[14 + n :]
