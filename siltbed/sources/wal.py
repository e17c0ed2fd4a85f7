"""The write-ahead log: frames appended as Parquet in group commits, replayed into the latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.wire import ACK, header, framed, unframed
from siltbed.operators.positions import with_positions
from siltbed.operators.upsert import last_writer_wins

#: Fixed value: commands in a group commit at most.
BATCH = 1024


def append(log: DataFrame, path: str) -> None:
    """Durable when the write's commit is: readers see all of it or nothing."""
    framed(log).write.mode("append").parquet(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, seq): the latest state, from the frames alone."""
    return replayed(spark.read.parquet(path))


def replayed(frames: DataFrame) -> DataFrame:
    c = unframed(frames.select(F.col("frame").alias("buffer")))
    return last_writer_wins(c.select(F.col("request_id").cast("long").alias("seq"), "cmd_type", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")))


def batches(log: DataFrame, size: int = BATCH) -> DataFrame:
    """(b, n, bytes) of the group commits of a log whose writer always finds full queues."""
    rows = with_positions(log.select("seq", (20 + F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes")), [F.col("seq")])
    return rows.groupBy(F.floor(F.col("pos") / size).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))


def acks(log: DataFrame, workers: int = 4) -> DataFrame:
    """The header that answers each PUT: its key_len stays though no key follows, and client_id is the
    worker that read the command."""
    client, k = F.pmod("seq", F.lit(workers)).cast("long"), F.octet_length("key")
    return log.select(F.lit(ACK).alias("cmd_type"), k.alias("key_len"), F.lit(0).alias("val_len"), client.alias("client_id"), F.col("seq").alias("request_id"), F.lower(F.hex(header(F.lit(ACK), k, F.lit(0), client, F.col("seq")))).alias("header"))
