"""Point and batch lookups through levels (level_rank, key, value); rank 0 is the newest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.operators.upsert import status


def newest(levels: DataFrame) -> DataFrame:
    return levels.groupBy("key").agg(F.min_by("value", "level_rank").alias("value"), F.min("level_rank").alias("level_rank"))


def get_point(levels: DataFrame, key: str) -> DataFrame:
    """One key: the equality reaches the scans."""
    one = levels.where(F.col("key") == key).agg(F.min_by("value", "level_rank").alias("v"))
    return one.select(F.lit(key).alias("key"), *status(F.col("v")))


def get_batch(probes: DataFrame, levels: DataFrame, logical: bool = False) -> DataFrame:
    """(key, status_code, value, val_len, level_rank) of every probe, level_rank -1 where no level has it. logical: tombstones are misses.
    Levels are first thinned to the probed keys; Catalyst broadcasts the probes where they are small."""
    hit = newest(levels.join(probes.select("key").distinct(), "key", "left_semi"))
    value = F.when(F.octet_length("value") > 0, F.col("value")) if logical else F.col("value")
    return probes.select("key").join(hit, "key", "left").select("key", *status(value), F.coalesce("level_rank", F.lit(-1)).alias("level_rank"))


def exists(probes: DataFrame, levels: DataFrame) -> DataFrame:
    return probes.join(levels, "key", "left_semi").select("key")


def missing(probes: DataFrame, levels: DataFrame) -> DataFrame:
    return probes.join(levels, "key", "left_anti").select("key")
