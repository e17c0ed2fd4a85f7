"""Sorted-table files, byte for byte.

Layout: records `u32 k_len, key, u32 v_len, value`; the sparse index `u32 k_len, key, u64 offset` of
every 64th key; the Bloom filter's bytes; a footer of four u64 (index offset and size, Bloom offset and
size) and the magic number. Little-endian. Reading goes through Spark's binaryFile source, so any store
that Spark reads will do; every read checks the magic and stops at the end of the records."""

from __future__ import annotations

import bisect
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.hashing import bloom_build, bloom_probe
from siltbed.operators.runs import INTERVAL

# Fixed values of the format.
FOOTER, MAGIC = struct.Struct("<5Q"), 0xDEADBEEF
_U32, _U64 = struct.Struct("<I"), struct.Struct("<Q")


def encode(rows: list[tuple[bytes, bytes]], bloom_keys: int | None = None, interval: int = INTERVAL) -> bytes:
    """A file of rows in strictly ascending order of keys; others are refused."""
    data, index, at = [], [], 0
    for i, (k, v) in enumerate(rows):
        if i and rows[i - 1][0] >= k:
            raise ValueError("keys must ascend")
        if i % interval == 0:
            index.append(_U32.pack(len(k)) + k + _U64.pack(at))
        data += [_U32.pack(len(k)), k, _U32.pack(len(v)), v]
        at += 8 + len(k) + len(v)
    entries, bloom = b"".join(index), bloom_build([k for k, _ in rows], bloom_keys)
    return b"".join([*data, entries, bloom, FOOTER.pack(at, len(entries), at + len(entries), len(bloom), MAGIC)])


class Table:
    """An opened file."""

    def __init__(self, raw: bytes):
        if len(raw) < FOOTER.size:
            raise ValueError("corrupt table: no footer")
        at, size, bloom, bloom_size, magic = FOOTER.unpack_from(raw, len(raw) - FOOTER.size)
        if magic != MAGIC:
            raise ValueError("corrupt table: wrong magic number")
        self.raw, self.end, self.bloom = raw, at, raw[bloom : bloom + bloom_size]
        self.keys, self.offsets, p = [], [], at
        while p < at + size:
            n = _U32.unpack_from(raw, p)[0]
            self.keys.append(raw[p + 4 : p + 4 + n])
            self.offsets.append(_U64.unpack_from(raw, p + 4 + n)[0])
            p += 12 + n

    def scan(self, at: int = 0):
        raw = self.raw
        while at < self.end:
            k = _U32.unpack_from(raw, at)[0]
            v = _U32.unpack_from(raw, at + 4 + k)[0]
            yield raw[at + 4 : at + 4 + k], raw[at + 8 + k : at + 8 + k + v]
            at += 8 + k + v

    def get(self, key: bytes) -> bytes | None:
        if not bloom_probe(self.bloom, [key])[0]:
            return None
        slot = bisect.bisect_right(self.keys, key) - 1
        if slot < 0:
            return None
        for k, v in self.scan(self.offsets[slot]):
            if k >= key:
                return v if k == key else None
        return None


def blobs(run: DataFrame, files: int, bloom_keys: int | None = None) -> DataFrame:
    """(sst): the run as `files` tables of ascending key ranges. A file is built in memory."""

    def build(it):
        rows = [(k.encode() if isinstance(k, str) else k, v.encode() if isinstance(v, str) else v) for b in it for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([encode(rows, bloom_keys)], pa.binary())], ["sst"])

    return run.select("key", "value").repartitionByRange(files, "key").sortWithinPartitions("key").mapInArrow(build, "sst binary")


def rows_of(tables: DataFrame, column: str = "sst") -> DataFrame:
    """(key, value), as bytes, of tables held in a binary column."""

    def read(it):
        for batch in it:
            for raw in batch.column(0).to_pylist():
                found = list(Table(raw).scan())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], ["key", "value"])

    return tables.select(column).mapInArrow(read, "key binary, value binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    return rows_of(spark.read.format("binaryFile").load(path), "content")


def write(run: DataFrame, folder: str, files: int, bloom_keys: int | None = None) -> list[str]:
    """Files of unique names under a folder that all executors reach; returns their names. A file
    appears under its name only when it is whole, so a task that is tried again leaves no half ones."""

    def put(it):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(top, recursive=True)
        for batch in it:
            names = []
            for raw in batch.column(0).to_pylist():
                name = f"table_{uuid.uuid4().hex}.sst"
                with store.open_output_stream(f"{top}/.{name}") as out:
                    out.write(raw)
                store.move(f"{top}/.{name}", f"{top}/{name}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    return sorted(r["name"] for r in blobs(run, files, bloom_keys).mapInArrow(put, "name string").collect())  # one name a file


def get(tables: DataFrame, key: bytes, column: str = "sst") -> DataFrame:
    """(value) of the key in each table that has it: filter, index and scan, as a reader would."""

    def look(it):
        for batch in it:
            found = [v for raw in batch.column(0).to_pylist() if (v := Table(raw).get(key)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["value"])

    return tables.select(F.col(column)).mapInArrow(look, "value binary")
