"""A Spark data source for logs of CRC-checked records, and a decoder of flat BSON.

Register with ``spark.dataSource.register(RecordLog)``; then ``spark.read.format("recordlog").load(folder)`` and
``df.write.format("recordlog").save(folder)``.  A record is length (4 bytes), CRC-32C (4), lsn (8), payload, all little-endian.
Files are read whole by one task each; damaged records are skipped, and a damaged length ends its file.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillspark.functions.codecs import crc32c

HEAD = struct.Struct("<IIq")


def encode(lsn: int, payload: bytes) -> bytes:
    body = struct.pack("<q", lsn) + payload
    return HEAD.pack(len(payload), crc32c(body), lsn) + payload


def decode(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + HEAD.size <= len(data):
        n, crc, lsn = HEAD.unpack_from(data, at)
        payload = data[at + HEAD.size : at + HEAD.size + n]
        if len(payload) < n:
            return
        if crc32c(struct.pack("<q", lsn) + payload) == crc:
            yield lsn, payload
        at += HEAD.size + n


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, since: int):
        self.path, self.since = path, since

    def partitions(self):
        from pyarrow import fs

        where, path = _files(self.path)
        found = where.get_file_info(fs.FileSelector(path, recursive=False))
        return [InputPartition(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".log")]

    def read(self, partition):
        where, _ = _files(self.path)
        with where.open_input_stream(partition.value) as f:
            data = f.read()
        for lsn, payload in decode(data):
            if lsn >= self.since:
                yield lsn, payload


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        where, path = _files(self.path)
        where.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}"
        with where.open_output_stream(f"{name}.tmp") as f:
            for r in rows:
                f.write(encode(r[0], bytes(r[1])))
        return _Written(name)

    def commit(self, messages):
        """Only files of tasks that Spark commits get their names."""
        where, _ = _files(self.path)
        for m in messages:
            if m is not None:
                where.move(f"{m.name}.tmp", f"{m.name}.log")

    def abort(self, messages):
        where, _ = _files(self.path)
        for m in messages:
            if m is not None:
                where.delete_file(f"{m.name}.tmp")


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class RecordLog(DataSource):
    """Rows (lsn, payload). Option since: the first lsn wanted."""

    @classmethod
    def name(cls) -> str:
        return "recordlog"

    def schema(self) -> str:
        return "lsn long, payload binary"

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("since", -(2**63))))

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"])


def bson_fields(data: bytes) -> dict:
    """Fields of a flat document: doubles, texts, booleans, dates (ms), nulls and whole numbers; other kinds end it."""
    out, at = {}, 4
    while at < len(data) and data[at]:
        kind = data[at]
        end = data.index(0, at + 1)
        name, at = data[at + 1 : end].decode(), end + 1
        if kind == 0x01:
            out[name] = struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 0x02:
            n = struct.unpack_from("<i", data, at)[0]
            out[name] = data[at + 4 : at + 3 + n].decode()
            at += 4 + n
        elif kind == 0x08:
            out[name] = bool(data[at])
            at += 1
        elif kind in (0x09, 0x12):
            out[name] = struct.unpack_from("<q", data, at)[0]
            at += 8
        elif kind == 0x0A:
            out[name] = None
        elif kind == 0x10:
            out[name] = struct.unpack_from("<i", data, at)[0]
            at += 4
        else:
            break
    return out


def bson_document(fields: dict) -> bytes:
    parts = []
    for k, v in fields.items():
        name = k.encode() + b"\0"
        if isinstance(v, bool):
            parts.append(b"\x08" + name + bytes([v]))
        elif isinstance(v, int):
            parts.append(b"\x12" + name + struct.pack("<q", v))
        elif isinstance(v, float):
            parts.append(b"\x01" + name + struct.pack("<d", v))
        elif v is None:
            parts.append(b"\x0a" + name)
        else:
            raw = str(v).encode() + b"\0"
            parts.append(b"\x02" + name + struct.pack("<i", len(raw)) + raw)
    body = b"".join(parts) + b"\0"
    return struct.pack("<i", len(body) + 4) + body


@functools.cache
def bson_json():
    """Pandas function from BSON to JSON text, done once at ingest; reads then use JSON functions."""

    @F.pandas_udf("string")
    def f(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else json.dumps(bson_fields(bytes(x))))

    return f
