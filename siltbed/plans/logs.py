"""Command logs and runs derived from the supplied tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltbed.functions.wire import GET, PUT
from siltbed.operators.positions import with_positions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(e: DataFrame) -> DataFrame:
    """view reads; error deletes by the empty value; all else writes props."""
    kind = F.col("event_type")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), F.when(kind == "view", GET).otherwise(PUT).alias("cmd_type"), F.when(kind == "view", None).when(kind == "error", "").otherwise(F.col("props")).alias("value"))


def events(spark, sf_dir) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o_"), F.col("o_orderkey").cast("string")).alias("key"), F.concat("o_orderstatus", "o_orderpriority").alias("value"))


def lineitem(spark, sf_dir) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    li = with_positions(table(spark, sf_dir, "lineitem").select(*order), [F.col(c) for c in order])
    text = lambda c: F.col(c).cast("string")
    key = F.concat(text("l_orderkey"), F.lit("-"), text("l_linenumber"))
    value = F.concat(text("l_partkey"), F.lit("|"), text("l_suppkey"), F.lit("|"), F.col("l_returnflag"), F.col("l_linestatus"), F.lit("|"), F.col("l_quantity").cast("long").cast("string"))
    return li.select(F.col("pos").alias("seq"), F.lit(PUT).alias("cmd_type"), key.alias("key"), value.alias("value"))


def event_runs(spark, sf_dir, n: int = 4) -> DataFrame:
    """The events' PUTs as n runs of equal ranges of seq, 0 the newest."""
    from siltbed.operators.upsert import puts

    log = events(spark, sf_dir)
    total = log.agg(F.count(F.lit(1)).alias("total"))
    run = (F.lit(n - 1) - F.floor(F.col("seq") * n / F.col("total"))).cast("int")
    return puts(log).join(F.broadcast(total)).groupBy(run.alias("run_idx"), "key").agg(F.max_by("value", "seq").alias("value"))  # total is one row


def probes(spark, n: int = 300) -> DataFrame:
    return spark.range(n).select(F.concat(F.lit("user_"), F.col("id").cast("string")).alias("key"))


def with_absent(keys: DataFrame) -> DataFrame:
    """Every key, and as many absent ones made by a suffix."""
    return keys.select("key").unionByName(keys.select(F.concat("key", F.lit("x")).alias("key")))


def every_user(spark, sf_dir) -> DataFrame:
    """The key of every user of the events, and as many absent ones."""
    return with_absent(events(spark, sf_dir).select("key").distinct())


CMDS = """cmds AS (SELECT event_id AS seq, 'user_' || CAST(user_id AS VARCHAR) AS key,
  CASE WHEN event_type = 'view' THEN 1 ELSE 2 END AS cmd_type,
  CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'error' THEN '' ELSE props END AS value FROM events)"""
LWW = f"{CMDS}, lww AS (SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM cmds WHERE cmd_type = 2 GROUP BY key)"
RUN = "run AS (SELECT 'o_' || CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus || o_orderpriority AS value FROM orders)"
USERS = "users AS (SELECT DISTINCT 'user_' || CAST(user_id AS VARCHAR) AS key FROM events), probes AS (SELECT key FROM users UNION ALL SELECT key || 'x' FROM users)"
INDEX = f"""{RUN}, e AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos,
  coalesce(sum(8 + strlen(key) + strlen(value)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM run),
si AS (SELECT key, CAST(off AS BIGINT) AS off, CAST(pos AS BIGINT) AS pos FROM e WHERE pos % 64 = 0)"""


def runs_sql(n: int) -> str:
    return f"""{CMDS}, runs AS (SELECT CAST({n - 1} - floor(seq * {n} / (SELECT count(*) FROM events)) AS INTEGER) AS run_idx, key, arg_max(value, seq) AS value
  FROM cmds WHERE cmd_type = 2 GROUP BY 1, 2)"""


FLUSH = """puts AS (SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS seq,
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS key,
  CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|' || l_returnflag || l_linestatus || '|' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem),
a AS MATERIALIZED (SELECT seq, strlen(key) AS kl, strlen(value) AS vl, lag(seq) OVER w AS pseq, lag(strlen(value)) OVER w AS pvl FROM puts WINDOW w AS (PARTITION BY key ORDER BY seq)),
b(gen, last_seq, bytes) AS (SELECT 0, CAST(-1 AS BIGINT), CAST(0 AS HUGEINT) UNION ALL
  SELECT gen + 1, s, cum FROM (SELECT gen, seq AS s, cum, row_number() OVER (ORDER BY seq) AS rn FROM
    (SELECT b.gen, a.seq, sum(CASE WHEN a.pseq > b.last_seq THEN a.vl - a.pvl ELSE a.kl + a.vl END) OVER (ORDER BY a.seq) AS cum FROM a, b WHERE a.seq > b.last_seq) WHERE cum >= 65536) WHERE rn = 1),
f AS (SELECT CAST(gen AS BIGINT) AS gen, last_seq, CAST(bytes AS BIGINT) AS bytes FROM b WHERE gen > 0)"""
