"""Wire frames: a packed little-endian header `<BBHQQ` (type, key_len, val_len, client_id, request_id),
then key and value bytes."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the protocol.
GET, PUT, DEL, ACK = 1, 2, 3, 4
HEADER = struct.Struct("<BBHQQ")
MAX_KEY, MAX_VALUE = 255, 1024

COMMAND = "cmd_type int, key_len int, val_len int, client_id decimal(20,0), request_id decimal(20,0), key binary, value binary"


def little_endian(c: Column, n_bytes: int) -> Column:
    """The low n_bytes of a non-negative number, lowest first, in hexadecimal digits; JVM only."""
    digits = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(n_bytes)])


def header(cmd_type: Column, key_len: Column, val_len: Column, client_id: Column, request_id: Column) -> Column:
    return F.unhex(F.concat(little_endian(cmd_type, 1), little_endian(key_len, 1), little_endian(val_len, 2), little_endian(client_id, 8), little_endian(request_id, 8)))


def framed(log: DataFrame, client_id: Column | None = None) -> DataFrame:
    """(seq, frame) of a command log (seq, cmd_type, key, value), in built-in functions."""
    key, value = F.encode("key", "UTF-8"), F.encode(F.coalesce("value", F.lit("")), "UTF-8")
    head = header(F.col("cmd_type"), F.octet_length(key), F.octet_length(value), F.lit(0) if client_id is None else client_id, F.col("seq"))
    return log.select("seq", F.concat(head, key, value).alias("frame"))


def limits(key: Column, value: Column) -> Column:
    """`ok`, or why a command has to be set aside; limits are in bytes."""
    return F.when(F.octet_length(key) > MAX_KEY, "key_too_long").when(F.octet_length(value) > MAX_VALUE, "value_too_long").otherwise("ok")


def walk(buffer: bytes):
    """The commands of a buffer, and how many bytes they take; a cut-off tail is left."""
    at, found = 0, []
    while at + HEADER.size <= len(buffer):
        kind, k, v, client, request = HEADER.unpack_from(buffer, at)
        end = at + HEADER.size + k + v
        if end > len(buffer):
            break
        found.append((kind, k, v, client, request, buffer[at + HEADER.size : at + HEADER.size + k], buffer[end - v : end]))
        at = end
    return found, at


def unframed(buffers: DataFrame, column: str = "buffer") -> DataFrame:
    """The commands of each row's bytes. Unknown types come out too: callers set them aside."""
    from decimal import Decimal

    def run(it):
        for batch in it:
            rows = [c for b in batch.column(0).to_pylist() if b for c in walk(b)[0]]
            c = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(map(Decimal, c[3]), pa.decimal128(20, 0)), pa.array(map(Decimal, c[4]), pa.decimal128(20, 0)), pa.array(c[5], pa.binary()), pa.array(c[6], pa.binary())],
                ["cmd_type", "key_len", "val_len", "client_id", "request_id", "key", "value"],
            )

    return buffers.select(column).mapInArrow(run, COMMAND)
