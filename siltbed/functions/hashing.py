"""MurmurHash64A and the Bloom filter that double hashing builds on it, bit-exact over numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.session import checkpointed, partitions

# Constants of MurmurHash64A, the seed and the shape of the filters.
M, R, SEED = 0xC6A4A7935BD1E995, 47, 0x9747B28C
BITS_PER_KEY, PROBES = 10.0, 7

#: Bytes of a filter that are a row, and that a task probes.
PIECE, SEGMENT = 1 << 16, 1 << 22
#: Keys that a task hashes before it sends what it has.
GATHER = 1 << 20


def murmur64(keys: list[bytes], seed: int = SEED) -> np.ndarray:
    """Hashes of byte strings as uint64. Keys of one length are hashed together, word by word."""
    out = np.empty(len(keys), np.uint64)
    sizes = np.array([len(k) for k in keys], np.int64)
    m, r = np.uint64(M), np.uint64(R)
    with np.errstate(over="ignore"):
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            whole = int(size) // 8
            raw = np.zeros((len(rows), (whole + 1) * 8), np.uint8)
            if size:
                raw[:, :size] = np.frombuffer(b"".join(keys[i] for i in rows), np.uint8).reshape(len(rows), size)
            block = raw.view("<u8")
            h = np.full(len(rows), np.uint64(seed) ^ (np.uint64(size) * m), np.uint64)
            for i in range(whole):
                k = block[:, i] * m
                h = (h ^ ((k ^ (k >> r)) * m)) * m
            if size % 8:
                h = (h ^ block[:, whole]) * m
            h = (h ^ (h >> r)) * m
            out[rows] = h ^ (h >> r)
    return out


def bloom_bytes(n_keys: int, bits_per_key: float = BITS_PER_KEY) -> int:
    return (max(int(n_keys * bits_per_key), 64) + 7) // 8


def probes(hashes: np.ndarray, n_bytes: int, k: int = PROBES) -> np.ndarray:
    """(keys, k) bit numbers: the sums of the halves wrap at 32 bits before the modulus."""
    low, high = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        steps = low[:, None] + np.arange(k, dtype=np.uint32) * high[:, None]
    return (steps.astype(np.uint64) % np.uint64(n_bytes * 8)).astype(np.int64)


def bloom_build(keys: list[bytes], n_keys: int | None = None) -> bytes:
    bits = np.zeros(bloom_bytes(len(keys) if n_keys is None else n_keys), np.uint8)
    at = probes(murmur64(keys), len(bits)).ravel()
    np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return bits.tobytes()


def bloom_probe(bits: bytes, keys: list[bytes]) -> np.ndarray:
    """False: surely absent. A filter without bytes holds nothing."""
    if not bits:
        return np.zeros(len(keys), bool)
    raw = np.frombuffer(bits, np.uint8)
    at = probes(murmur64(keys), len(raw))
    return ((raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)


def _keys(column) -> list[bytes]:
    return [k.encode() if isinstance(k, str) else (k or b"") for k in column.to_pylist()]


def with_murmur(df: DataFrame, key: str = "key") -> DataFrame:
    """(key, hash): the hash as 16 hexadecimal digits, which keep the full unsigned range."""

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{h:016x}" for h in murmur64(_keys(batch.column(0))).tolist()], pa.string())], ["key", "hash"])

    return df.select(df[key].alias("key")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, hash string")


def with_bits(df: DataFrame, n_keys: int, key: str = "key") -> DataFrame:
    """(key, bits): the bit numbers that a filter for n_keys keys sets."""

    def run(it):
        for batch in it:
            at = probes(murmur64(_keys(batch.column(0))), bloom_bytes(n_keys))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at.tolist(), pa.list_(pa.int64()))], ["key", "bits"])

    return df.select(df[key].alias("key")).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, bits array<long>")


def build(df: DataFrame, n_keys: int, key: str = "key") -> DataFrame:
    """One filter over all keys, as rows (byte_no, byte) of its non-zero bytes: tasks set bits in their
    own filters, and equal bytes are or-ed by key, so no task needs all keys."""
    size = bloom_bytes(n_keys)

    def run(it):
        bits = np.zeros(size, np.uint8)
        for batch in it:
            if batch.num_rows:
                at = probes(murmur64(_keys(batch.column(0))), size).ravel()
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(bits[some].astype(np.int32), pa.int32())], ["byte_no", "byte"])

    return df.select(df[key].alias("key")).mapInArrow(run, "byte_no long, byte int").groupBy("byte_no").agg(F.bit_or("byte").alias("byte"))


def _hashes(it):
    """The hashes of at most about GATHER keys of the batches' first column at a time."""
    held, size = [], 0
    for batch in it:
        held.append(murmur64(_keys(batch.column(0))))
        size += batch.num_rows
        if size >= GATHER:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def pieces(df: DataFrame, n_keys: int, key: str = "key") -> DataFrame:
    """One filter over all keys, as rows (piece, bits) of PIECE bytes; pieces without a set bit are left
    out. Tasks send the bits of their keys by piece, so none holds the whole filter."""
    size, width = bloom_bytes(n_keys), PIECE

    def send(it):
        for hashes in _hashes(it):
            at = np.unique(probes(hashes, size))
            own, begin = np.unique(at // (width * 8), return_index=True)
            for piece, bits in zip(own.tolist(), np.split(at, begin[1:])):
                inside = bits - piece * width * 8
                whole = len(inside) * 4 >= width  # then its bytes are fewer than its bits' numbers
                if whole:
                    raw = np.zeros(width * 8, np.uint8)
                    raw[inside] = 1
                    raw = np.packbits(raw, bitorder="little")
                else:
                    raw = inside.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([whole]), pa.array([raw.tobytes()], pa.binary())], ["piece", "whole", "bits"])

    def unite(it):
        last, found = None, None
        for batch in it:
            for piece, whole, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if piece != last:
                    if last is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["piece", "bits"])
                    last, found = piece, np.zeros(width, np.uint8)
                if whole:
                    found |= np.frombuffer(raw, np.uint8)
                else:
                    at = np.frombuffer(raw, np.uint32)
                    np.bitwise_or.at(found, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["piece", "bits"])

    sent = df.select(df[key].alias("key")).mapInArrow(send, "piece long, whole boolean, bits binary")
    return sent.repartition(partitions(df.sparkSession), "piece").sortWithinPartitions("piece").mapInArrow(unite, "piece long, bits binary")


def maybe_held(df: DataFrame, n_keys: int, asked: DataFrame, tag: str, key: str = "key") -> DataFrame:
    """(tag, maybe): by the boolean tag of the asked keys, how many of them the filter over df's keys may
    hold. The filter lies in segments of SEGMENT bytes and the hashes of the asked keys go from segment
    to segment, in ascending order of those that their bits are in, as long as all their bits are set: so
    no task and no driver holds more of the filter than a segment, whatever its size."""
    size, width, piece_width = bloom_bytes(n_keys), SEGMENT, PIECE
    segments = -(-size // width)
    shares = -(-partitions(df.sparkSession) // segments)  # tasks of a segment
    row = "bucket int, kind int, tag boolean, n long, blob binary"
    names = ["bucket", "kind", "tag", "n", "blob"]

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()))], names)

    def dealt(hashes, segment, tagged):
        """The hashes to tasks of the segments."""
        by = segment * shares + ((hashes >> np.uint64(17)) % np.uint64(shares)).astype(np.int64)
        order = np.argsort(by, kind="stable")
        own, begin = np.unique(by[order], return_index=True)
        return [(b, 1, tagged, 0, part.tobytes()) for b, part in zip(own.tolist(), np.split(hashes[order], begin[1:]))]

    def ask(tagged):
        def run(it):
            for hashes in _hashes(it):
                yield rows(dealt(hashes, probes(hashes, size).min(1) // (width * 8), tagged))

        return run

    def look(it):
        last, bits = None, None
        for batch in it:
            for bucket, kind, tagged, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 2:  # counted before
                    yield rows([(bucket, kind, tagged, n, None)])
                    continue
                if bucket != last:
                    last, bits = bucket, np.zeros(width, np.uint8)
                segment = bucket // shares
                if kind == 0:
                    begin = n * piece_width - segment * width
                    bits[begin : begin + piece_width] = np.frombuffer(blob, np.uint8)
                    continue
                every = np.frombuffer(blob, np.uint64)
                for lo in range(0, len(every), 1 << 16):
                    hashes = every[lo : lo + (1 << 16)]
                    at = probes(hashes, size)
                    of = at // (width * 8)
                    inside = at - segment * width * 8
                    here = of == segment
                    inside[~here] = 0
                    held = ((bits[inside >> 3] >> (inside & 7).astype(np.uint8) & 1).astype(bool) | ~here).all(1)
                    further = np.where(of[held] > segment, of[held], segments).min(1)
                    left = further < segments
                    out = dealt(hashes[held][left], further[left], tagged)
                    yield rows([*out, (bucket, 2, tagged, int((~left).sum()), None)])

    part = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    bits = checkpointed(pieces(df, n_keys, key))
    table = bits.select(F.expr(f"piece div {width // piece_width}").alias("segment"), "piece", "bits", part.alias("share")).select((F.col("segment") * shares + F.col("share")).cast("int").alias("bucket"), F.lit(0).alias("kind"), F.lit(None).cast("boolean").alias("tag"), F.col("piece").alias("n"), F.col("bits").alias("blob"))
    going = [asked.where(F.col(tag) == t).select(F.col(key).alias("key")).mapInArrow(ask(t), row) for t in (True, False)]
    going = going[0].unionByName(going[1])
    for _ in range(min(segments, PROBES)):
        going = table.unionByName(going).repartitionById(segments * shares, F.col("bucket")).sortWithinPartitions("bucket", "kind").mapInArrow(look, row)
    return going.where("kind = 2").groupBy(F.col("tag").alias(tag)).agg(F.sum("n").alias("maybe"))
