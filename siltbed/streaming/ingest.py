"""Continuous ingest: a stream of commands into the log, micro-batch by micro-batch, and state by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.wire import limits
from siltbed.operators.upsert import puts


def commands(spark: SparkSession, schema, path: str, max_files: int | None = None) -> DataFrame:
    """Files that land under a path, as a stream. max_files a micro-batch is the back pressure."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append(log: DataFrame, path: str, checkpoint: str):
    """Writes a command stream to the log until what is there now is done; commands over the limits go
    to `quarantine` beside it. The file sink's commit log makes a batch visible once and whole, and a
    restart goes on from the checkpoint."""
    state = limits(F.col("key"), F.coalesce("value", F.lit("")))
    marked = log.withColumn("why", state)

    good = marked.where("why = 'ok'").drop("why").writeStream.format("parquet").option("path", f"{path}/log").option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()
    bad = marked.where("why <> 'ok'").writeStream.format("parquet").option("path", f"{path}/quarantine").option("checkpointLocation", f"{checkpoint}/quarantine").trigger(availableNow=True).start()
    for query in (good, bad):
        query.awaitTermination()


def upserted(log: DataFrame) -> DataFrame:
    """(key, value, seq) as a streaming aggregation: late commands don't matter, the highest seq wins."""
    last = puts(log).groupBy("key").agg(F.max(F.struct("seq", "value")).alias("last"))
    return last.select("key", "last.value", "last.seq")
