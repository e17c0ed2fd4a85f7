"""Upserts, replayed reads and merges over command logs (seq, cmd_type, key, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.functions.wire import DEL, GET, PUT


def puts(log: DataFrame) -> DataFrame:
    """What changes values: PUT, and DEL as the empty value."""
    return log.where(F.col("cmd_type").isin(PUT, DEL)).select("seq", "key", F.when(F.col("cmd_type") == DEL, "").otherwise(F.coalesce("value", F.lit(""))).alias("value"))


def last_writer_wins(log: DataFrame) -> DataFrame:
    """(key, value, seq): the latest value of each key. Partial aggregation first, so a hot key
    comes to its task once from each other."""
    return puts(log).groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def live(state: DataFrame) -> DataFrame:
    """Without tombstones. Only after the merge: a tombstone must first hide older values."""
    return state.where(F.octet_length("value") > 0)


def memtable_size(log: DataFrame) -> DataFrame:
    """(bytes, n_keys) of the latest values."""
    size = F.octet_length("key") + F.octet_length("value")
    return last_writer_wins(log).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n_keys"))


def status(value: Column) -> list[Column]:
    """Hit or miss: 0 with the value, 1 with nothing."""
    v = F.coalesce(value, F.lit(""))
    return [F.when(value.isNull(), 1).otherwise(0).alias("status_code"), v.alias("value"), F.octet_length(v).cast("long").alias("val_len")]


def get_replay(log: DataFrame) -> DataFrame:
    """(seq, key, status_code, value, val_len): every GET sees the PUTs before it. One sort by key and
    seq; the frame is a running one, which is computed as the rows stream by."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    written = F.when(F.col("cmd_type") == DEL, "").when(F.col("cmd_type") == PUT, F.coalesce("value", F.lit("")))
    seen = log.select("seq", "key", "cmd_type", F.last(written, ignorenulls=True).over(before).alias("seen"))
    return seen.where(F.col("cmd_type") == GET).select("seq", "key", *status(F.col("seen")))


def kway_merge(runs: DataFrame) -> DataFrame:
    """(key, value, src_run) of rows (run_idx, key, value); the newest run, 0, wins."""
    return runs.groupBy("key").agg(F.min_by("value", "run_idx").alias("value"), F.min("run_idx").alias("src_run"))


def compaction_plan(manifest: DataFrame, fan_in: int = 4) -> DataFrame:
    """The oldest `fan_in` runs of a manifest (level_rank, ...; 0 is newest), if there are as many."""
    enough = manifest.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= fan_in)
    return manifest.orderBy(F.desc("level_rank")).limit(fan_in).join(F.broadcast(enough)).drop("_n")  # one row
