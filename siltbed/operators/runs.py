"""Sorted runs: sparse index, seek, footer, and the flush fold."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.operators.positions import with_positions
from siltbed.operators.upsert import puts

# Bytes of a memtable at which it is frozen, and keys to an index entry.
THRESHOLD, INTERVAL = 65_536, 64


def record_size():
    return F.octet_length("key") + F.octet_length("value") + 8


def sparse_index(run: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """(key, off, pos) of every `interval`-th key: its byte offset and place in the run."""
    return with_positions(run.select("key", "value"), [F.col("key")], record_size()).where(F.col("pos") % interval == 0).select("key", "off", "pos")


def sparse_seek(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, off) by probe: the offset of the greatest indexed key that is not above it, null before the
    first. As-of lookup by one sort of both sides together: range partitions with the last entry of
    those before each, so the index need not fit anywhere."""
    both = index.select("key", F.lit(0).alias("side"), F.col("off").alias("entry")).unionByName(probes.select("key", F.lit(1).alias("side"), F.lit(None).cast("long").alias("entry")))
    rows = with_positions(both, [F.col("key"), F.col("side")])
    # entries by blocks of rows; a block's probes look within it or at the last entry of a block before
    block = rows.withColumn("block", F.floor(F.col("pos") / 65_536))
    inside = Window.partitionBy("block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = block.groupBy("block").agg(F.max_by("entry", F.when(F.col("side") == 0, F.col("pos"))).alias("last"))
    carried = ends.withColumn("before", F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).select("block", "before")  # one row for 65,536
    found = block.withColumn("here", F.last("entry", ignorenulls=True).over(inside)).where("side = 1").join(carried, "block")
    return found.select("key", F.coalesce("here", "before").alias("off"))


def footer(run: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """(n_keys, index_offset, index_size, bloom_offset, bloom_size) of the run's file."""
    sums = run.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(record_size()), F.lit(0)).alias("index_offset"))
    index = sparse_index(run, interval).agg(F.coalesce(F.sum(F.octet_length("key") + 12), F.lit(0)).alias("index_size"))
    bloom = F.floor((F.greatest(F.col("n_keys") * 10, F.lit(64)) + 7) / 8).cast("long")
    return sums.join(F.broadcast(index)).select("n_keys", "index_offset", "index_size", (F.col("index_offset") + F.col("index_size")).alias("bloom_offset"), bloom.alias("bloom_size"))  # one row each


def generations(log: DataFrame, shards: int = 1, threshold: int = THRESHOLD) -> DataFrame:
    """(shard, gen, seq, key, value, closes, bytes): the generation, from 1, of every PUT of a log. A
    generation closes with the PUT that brings it to `threshold` bytes; an overwrite within it counts
    only the change of the value's size.

    The fold is sequential in seq: a shard is one stream, read in order with two numbers of state. One
    shard is the single-writer's result; more deal the keys by hash and fold in parallel, each with
    its own boundaries."""
    order = Window.partitionBy("key").orderBy("seq")
    rows = puts(log).select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "seq", "key", "value",
        F.octet_length("key").alias("kl"), F.octet_length("value").alias("vl"),
        F.lag("seq").over(order).alias("pseq"), F.lag(F.octet_length("value")).over(order).alias("pvl"),
    )

    def fold(it):
        shard, gen, last, size = None, 1, None, 0
        for batch in it:
            gens, closes, sizes = [], [], []
            columns = [batch.column(k).to_pylist() for k in (0, 1, 4, 5, 6, 7)]
            for s, seq, kl, vl, pseq, pvl in zip(*columns):
                if s != shard:
                    shard, gen, last, size = s, 1, None, 0
                again = pseq is not None and (last is None or pseq > last)
                size += vl - pvl if again else kl + vl
                full = size >= threshold
                gens.append(gen)
                closes.append(full)
                sizes.append(size)
                if full:
                    gen, last, size = gen + 1, seq, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gens, pa.int64()), batch.column(1), batch.column(2), batch.column(3), pa.array(closes, pa.bool_()), pa.array(sizes, pa.int64())], ["shard", "gen", "seq", "key", "value", "closes", "bytes"])

    return rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "seq").mapInArrow(fold, "shard int, gen long, seq long, key string, value string, closes boolean, bytes long")


def flush_boundaries(log: DataFrame) -> DataFrame:
    return generations(log).where("closes").select("gen", F.col("seq").alias("last_seq"), "bytes")


def flush_runs(log: DataFrame) -> DataFrame:
    """(gen, file, n_keys, bytes, bloom_keys, min_key, max_key) of the flushed generations."""
    rows = generations(log)
    closed = rows.where("closes").select("gen")
    latest = rows.groupBy("gen", "key").agg(F.max_by("value", "seq").alias("value"))
    size = F.octet_length("key") + F.octet_length("value")
    stats = latest.groupBy("gen").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(size).alias("bytes"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))
    return stats.join(closed, "gen", "left_semi").select("gen", F.format_string("table_%d.sst", "gen").alias("file"), "n_keys", "bytes", (F.floor(F.col("bytes") / 50) + 100).cast("long").alias("bloom_keys"), "min_key", "max_key")


def level_set(flushes: DataFrame, fan_in: int = 4) -> DataFrame:
    """(level_rank, file) that remain of flushes (gen), newest first, with compaction of the oldest
    `fan_in` whenever there are as many: after c compactions the first 1 + c * (fan_in - 1) flushes
    are in one file."""
    step = fan_in - 1
    last = flushes.agg(F.max("gen").alias("last")).select("last", F.greatest(F.lit(0), F.floor((F.col("last") - 1) / step)).cast("long").alias("c"))
    merged = F.when(F.col("c") > 0, 1 + F.col("c") * step).otherwise(0)
    rows = flushes.select("gen").join(F.broadcast(last))  # one row
    kept = rows.where(F.col("gen") > merged).select((F.col("last") - F.col("gen")).alias("level_rank"), F.format_string("table_%d.sst", "gen").alias("file"))
    one = last.where("c > 0").select((F.col("last") - merged).alias("level_rank"), F.format_string("table_compacted_%d.sst", "c").alias("file"))
    return kept.unionByName(one)
