"""Sharding along a Hilbert curve.

Four metadata dimensions of a document (language, source, length, id) are each cut at quantiles into
2^LEVELS cells; strings are cut as a whole, whatever their common prefix. The cell's index on the
four-dimensional Hilbert curve orders the documents, and runs of equal numbers of rows become the
shards. Documents near in all dimensions so share files, whose minima and maxima prune reads by any
of the dimensions.

Rows of equal text (same size, CRC-32 and 64-bit hash) are a class: all take the place of the class's
smallest row (by doc_id, language, source), and follow one another there by their own index and
doc_id. So a class lies in one shard or in neighbouring ones: at most shards - 1 classes are cut,
however many rows they have.

Only keys move, never texts: the ordering is one range partitioning of the keys, written to the
checkpoint folder, whose partition sizes (one number each) give every row its place. A class of any
size is spread over ranges; its smallest row is a partial aggregate.

Defined cases: null texts have size 1 and the checksum of no bytes and are of one class with empty
ones; null metadata sorts first; repeated rows keep their own places; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from siltbed.llm.common import NULL_ID, buckets, checkpointed, quoted, text_hash
from siltbed.operators.positions import with_positions

SHARDS, LEVELS = 16, 4
STRINGS, NUMBERS = ("lang", "source"), ("chars", "doc_id")


def hilbert(cells: np.ndarray, levels: int) -> np.ndarray:
    """Indices on the curve of cells (rows, dimensions), each coordinate of `levels` bits."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (levels - 1)
    while q > 1:  # undo rotations and reflections, coarsest first
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (levels - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(levels - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> bit & 1)
    return out


def keys(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, text hash and the dimensions; with whole, also the row itself."""
    text = docs["text"].cast("string")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        text_hash(docs["text"]).alias("thash"),
        docs["lang"].cast("string").alias("d_lang"),
        docs["source"].cast("string").alias("d_source"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("d_chars"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NULL_ID))).alias("d_doc_id"),
        *([F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row")] if whole else []),
    )


def string_limits(rows: DataFrame, name: str, total: int, cells: int) -> list[bytes | None]:
    """The distinct values at the `cells` - 1 quantiles of a string column, in order, null first. One
    row a value is ordered, over range partitions; only the limits come to the driver."""
    values = with_positions(rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")), [F.col(name)], F.col("n"))
    reached = lambda end: f"least({cells - 1}, ({end}) * {cells} div {total})"
    found = values.where(F.expr(f"{reached('off + n')} > {reached('off')}")).select(name).collect()
    return sorted((None if r[0] is None else r[0].encode() for r in found), key=lambda v: (v is not None, v or b""))


def string_cells(column: pa.Array, limits: list[bytes | None]) -> np.ndarray:
    """How many limits are not above each value."""
    codes = column.dictionary_encode(null_encoding="encode")
    nulls = sum(v is None for v in limits)
    own = [nulls if v is None else bisect_right(limits, v.encode(), nulls) for v in codes.dictionary.to_pylist()]
    return np.array(own, np.int64)[codes.indices.to_numpy(zero_copy_only=False)]


def ordered(docs: DataFrame, levels: int = LEVELS, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 (and the row, with whole), range-partitioned and sorted along the
    curve, classes together, and checkpointed."""
    rows = keys(docs, whole)
    numbers = rows.drop("row")
    parts = [i / (1 << levels) for i in range(1, 1 << levels)]
    cuts = numbers.agg(F.count(F.lit(1)).alias("total"), *[F.percentile_approx(f"d_{d}", parts, 10_000).alias(d) for d in NUMBERS]).first()  # 2^LEVELS - 1 limits a dimension
    limits = [np.array(cuts[d] if cuts[d] is not None else [], np.int64) for d in NUMBERS]
    texts = [string_limits(numbers, f"d_{d}", cuts["total"], 1 << levels) if cuts["total"] else [] for d in STRINGS]

    def run(it):
        for batch in it:
            cell = np.column_stack([
                *[string_cells(batch.column(f"d_{d}"), lim) for lim, d in zip(texts, STRINGS)],
                *[np.searchsorted(np.unique(lim), batch.column(f"d_{d}").to_numpy(), "right") for lim, d in zip(limits, NUMBERS)],
            ])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cell, levels), pa.int64())], names=[*batch.schema.names, "curve"])

    own = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("curve", LongType())]))
    same = ["size", "text_crc32", "thash"]
    leads = own.groupBy(*same).agg(F.min(F.struct("d_doc_id", "d_lang", "d_source", "curve")).alias("lead"))
    # a class of many rows is a skewed key of this join, whose other side has one row a class: AQE splits it
    found = own.join(leads, same).select(F.col("lead.curve").alias("first"), F.col("lead.d_doc_id").alias("lead"), *same, "curve", "doc_id", *(["row"] if whole else []))
    order = ["first", "lead", *same, "curve", "doc_id"]
    found = found.repartitionByRange(buckets(docs), *order).sortWithinPartitions(*order)
    return checkpointed(found.select("doc_id", "size", "text_crc32", *(["row"] if whole else [])))


def placed(docs: DataFrame, shards: int, whole: bool = False) -> DataFrame:
    """doc_id, size, text_crc32 (and the row), shard and slot."""
    rows = ordered(docs, whole=whole)

    def count(it):
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([sum(b.num_rows for b in it)], pa.int64())], ["part", "n"])

    sizes = {r["part"]: r["n"] for r in rows.select("size").mapInArrow(count, "part int, n long").collect()}  # one row a partition
    total = sum(sizes.values())
    base, at = {}, 0
    for p in sorted(sizes):
        base[p], at = at, at + sizes[p]
    # shard s begins at the first rank r with r * shards // total = s
    begin = np.array([-(-s * total // shards) for s in range(shards)], np.int64)

    def place(it):
        rank = base.get(TaskContext.get().partitionId(), 0)
        for b in it:
            r = np.arange(rank, rank + b.num_rows)
            rank += b.num_rows
            shard = r * shards // max(total, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32()), pa.array(r - begin[shard], pa.int64())], names=[*b.schema.names, "shard", "slot"])

    return rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("shard", IntegerType()), StructField("slot", LongType())]))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`: counts at most one apart), shard, slot (place in the shard,
    from 0), grown_shard (null under this law)."""
    return placed(docs, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> str:
    """The documents, all columns, as Parquet files by shard, rows in the order of the curve. The texts
    move once, with their keys. Returns the name of the shard's column: `shard`, with underscores
    after it until no column of docs has that name."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows = placed(docs, shards, whole=True).sortWithinPartitions("shard", "slot")
    rows.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name
