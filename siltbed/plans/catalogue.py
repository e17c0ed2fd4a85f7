"""The key-value queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltbed.functions import hashing, wire
from siltbed.operators import lookup, runs, upsert
from siltbed.plans import logs
from siltbed.session import partitions, shared_folder
from siltbed.sources import sst, wal
from siltbed.streaming import ingest


def _puts(spark, d):
    return logs.events(spark, d).where(F.col("cmd_type") == wire.PUT)


def _text(df):
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _levels(spark, d, n=4):
    return logs.event_runs(spark, d, n).withColumnRenamed("run_idx", "level_rank")


def _frame_decode(spark, d):
    """Frames of 64 commands in a row as one connection's bytes, and back."""
    frames = wire.framed(logs.events(spark, d)).groupBy(F.floor(F.col("seq") / 64).alias("part")).agg(F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("f"))
    c = wire.unframed(frames.select(F.aggregate("f.frame", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("buffer")))
    return c.select("cmd_type", "key_len", "val_len", F.col("client_id").cast("long").alias("client_id"), F.col("request_id").cast("long").alias("request_id"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _limits(spark, d):
    docs = logs.table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("key"), F.coalesce("text", F.lit("")).alias("value"))
    return docs.select(wire.limits(F.col("key"), F.col("value")).alias("why"), F.octet_length("value").cast("long").alias("n")).groupBy("why").agg(F.count(F.lit(1)).alias("commands"), F.sum("n").alias("value_bytes"))


def _sparse_seek(spark, d):
    asked = spark.range(0, 16000, 97).select(F.concat(F.lit("o_"), F.col("id").cast("string")).alias("key")).unionByName(spark.createDataFrame([("a",), ("zz",)], "key string"))
    return runs.sparse_seek(runs.sparse_index(logs.orders(spark, d)), asked)


def _sparse_seek_all(spark, d):
    """Every order's key, as many absent ones, and one before and after all."""
    run = logs.orders(spark, d)
    asked = logs.with_absent(run).unionByName(spark.createDataFrame([("a",), ("zz",)], "key string"))
    return runs.sparse_seek(runs.sparse_index(run), asked)


def _delete(spark, d):
    """Purchases delete, by the opcode; what is then alive."""
    e = logs.table(spark, d, "events")
    log = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("key"), F.when(F.col("event_type") == "purchase", wire.DEL).otherwise(wire.PUT).alias("cmd_type"), F.when(F.col("event_type") != "purchase", F.col("props")).alias("value"))
    return upsert.live(upsert.last_writer_wins(log)).select("key", "value")


def _bloom_probe(spark, d):
    """Which of the probes a filter over the orders' keys may hold; probes not in it are `absent`."""
    run = logs.orders(spark, d)
    n = run.count()
    asked = run.select("key", F.lit(True).alias("present")).unionByName(run.select(F.concat("key", F.lit("x")).alias("key"), F.lit(False).alias("present")))
    maybe = hashing.maybe_held(run, n, asked, "present")  # 10 bits a key of one run's file
    return asked.groupBy("present").agg(F.count(F.lit(1)).alias("n")).join(maybe, "present", "left").select("present", "n", F.coalesce("maybe", F.lit(0)).alias("maybe"))


def _stream_upsert(spark, d):
    """The events as a stream into the log, then its latest state."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    e = logs.table(spark, d, "events")
    stream = ingest.commands(spark, e.schema, f"{d}/events.parquet*")
    ingest.append(logs.from_events(stream), top, f"{top}/state")
    return upsert.last_writer_wins(spark.read.parquet(f"{top}/log"))


def queries() -> dict:
    ev, orders, levels = logs.events, logs.orders, _levels
    return {
        "kv_put_upsert": lambda s, d: upsert.last_writer_wins(ev(s, d)),
        "kv_compact_gc": lambda s, d: upsert.live(upsert.last_writer_wins(ev(s, d))).select("key", "value"),
        "kv_get_replay": lambda s, d: upsert.get_replay(ev(s, d)),
        "kv_memtable_size": lambda s, d: upsert.memtable_size(ev(s, d)),
        "kv_memtable_scan": lambda s, d: upsert.last_writer_wins(ev(s, d)).select("key", "value").orderBy("key"),
        "kv_kway_merge": lambda s, d: upsert.kway_merge(logs.event_runs(s, d)),
        "kv_compaction_plan": lambda s, d: upsert.compaction_plan(levels(s, d, 6).groupBy("level_rank").agg(F.count(F.lit(1)).alias("n_keys"))),
        "kv_delete": _delete,
        "kv_get_point": lambda s, d: lookup.get_point(levels(s, d), "user_7").unionByName(lookup.get_point(levels(s, d), "nobody")),
        "kv_get_batch": lambda s, d: lookup.get_batch(logs.probes(s), levels(s, d)).select("key", "status_code", "value"),
        "kv_get_levels": lambda s, d: lookup.get_batch(logs.probes(s), levels(s, d), logical=True),
        "kv_exists_semi": lambda s, d: lookup.exists(logs.probes(s), levels(s, d)),
        "kv_missing_anti": lambda s, d: lookup.missing(logs.probes(s), levels(s, d)),
        "kv_get_batch_all": lambda s, d: lookup.get_batch(logs.every_user(s, d), levels(s, d)).select("key", "status_code", "value"),
        "kv_get_levels_all": lambda s, d: lookup.get_batch(logs.every_user(s, d), levels(s, d), logical=True),
        "kv_exists_semi_all": lambda s, d: lookup.exists(logs.every_user(s, d), levels(s, d)),
        "kv_missing_anti_all": lambda s, d: lookup.missing(logs.every_user(s, d), levels(s, d)),
        "kv_round_robin": lambda s, d: ev(s, d).select(F.col("seq").alias("event_id"), F.pmod("seq", F.lit(4)).cast("int").alias("worker")),
        "kv_frame_decode": _frame_decode,
        "kv_limits": _limits,
        "kv_ack": lambda s, d: wal.acks(_puts(s, d)),
        "kv_wal_frames": lambda s, d: wire.framed(_puts(s, d)).select("seq", F.lower(F.hex("frame")).alias("frame")),
        "kv_wal_batches": lambda s, d: wal.batches(_puts(s, d)),
        "kv_wal_replay": lambda s, d: wal.replayed(wire.framed(ev(s, d))),
        "kv_sparse_index": lambda s, d: runs.sparse_index(orders(s, d)),
        "kv_sparse_seek": _sparse_seek,
        "kv_sparse_seek_all": _sparse_seek_all,
        "kv_sstable_footer": lambda s, d: runs.footer(orders(s, d)),
        "kv_sstable_scan": lambda s, d: _text(sst.rows_of(sst.blobs(orders(s, d), partitions(s)))),
        "kv_flush_boundaries": lambda s, d: runs.flush_boundaries(logs.lineitem(s, d)),
        "kv_flush_runs": lambda s, d: runs.flush_runs(logs.lineitem(s, d)),
        "kv_level_set": lambda s, d: runs.level_set(runs.flush_boundaries(logs.lineitem(s, d))),
        "kv_murmur64": lambda s, d: hashing.with_murmur(orders(s, d)),
        "kv_bloom_bits": lambda s, d: hashing.with_bits(orders(s, d), orders(s, d).count()),
        "kv_bloom_build": lambda s, d: hashing.build(orders(s, d), orders(s, d).count()),
        "kv_bloom_probe": _bloom_probe,
        "kv_stream_upsert": _stream_upsert,
    }


def _hex(value: str, n: int) -> str:
    """SQL for n little-endian bytes of a number, in hexadecimal digits."""
    return " || ".join(f"substr(printf('%016x', CAST({value} AS BIGINT)), {15 - 2 * i}, 2)" for i in range(n))


def oracle_sql() -> dict[str, str]:
    runs4, put = logs.runs_sql(4), f"WITH {logs.LWW} SELECT key, value, seq FROM lww"
    best = f"WITH {runs4}, m AS (SELECT key, arg_min(value, run_idx) AS v, min(run_idx) AS level_rank FROM runs GROUP BY key), probes AS (SELECT 'user_' || CAST(i AS VARCHAR) AS key FROM range(300) t(i))"
    best_all = f"WITH {runs4}, m AS (SELECT key, arg_min(value, run_idx) AS v, min(run_idx) AS level_rank FROM runs GROUP BY key), {logs.USERS}"
    frame = f"{_hex('cmd_type', 1)} || {_hex('strlen(key)', 1)} || {_hex('strlen(value)', 2)} || {_hex('0', 8)} || {_hex('seq', 8)} || lower(hex(key)) || lower(hex(value))"
    ack = f"{_hex('4', 1)} || {_hex('strlen(key)', 1)} || {_hex('0', 2)} || {_hex('seq % 4', 8)} || {_hex('seq', 8)}"
    return {
        "kv_put_upsert": put,
        "kv_wal_replay": put,
        "kv_stream_upsert": put,
        "kv_compact_gc": f"WITH {logs.LWW} SELECT key, value FROM lww WHERE value <> ''",
        "kv_memtable_scan": f"WITH {logs.LWW} SELECT key, value FROM lww",
        "kv_memtable_size": f"WITH {logs.LWW} SELECT CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes, count(*) AS n_keys FROM lww",
        "kv_get_replay": f"""WITH {logs.CMDS}, p AS (SELECT * FROM cmds WHERE cmd_type = 2), g AS (SELECT * FROM cmds WHERE cmd_type = 1)
SELECT g.seq, g.key, CASE WHEN p.key IS NULL THEN 1 ELSE 0 END AS status_code, coalesce(p.value, '') AS value, strlen(coalesce(p.value, '')) AS val_len FROM g ASOF LEFT JOIN p ON g.key = p.key AND g.seq > p.seq""",
        "kv_kway_merge": f"WITH {runs4} SELECT key, arg_min(value, run_idx) AS value, min(run_idx) AS src_run FROM runs GROUP BY key",
        "kv_compaction_plan": f"WITH {logs.runs_sql(6)} SELECT run_idx AS level_rank, count(*) AS n_keys FROM runs GROUP BY run_idx ORDER BY run_idx DESC LIMIT 4",
        "kv_delete": """SELECT key, value FROM (SELECT 'user_' || CAST(user_id AS VARCHAR) AS key, arg_max(CASE WHEN event_type = 'purchase' THEN '' ELSE coalesce(props, '') END, event_id) AS value FROM events GROUP BY user_id) WHERE value <> ''""",
        "kv_get_point": f"WITH {runs4}, k(key) AS (VALUES ('user_7'), ('nobody')), m AS (SELECT key, arg_min(value, run_idx) AS v FROM runs GROUP BY key) SELECT k.key, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS status_code, coalesce(v, '') AS value, strlen(coalesce(v, '')) AS val_len FROM k LEFT JOIN m ON k.key = m.key",
        "kv_get_batch": f"{best} SELECT probes.key, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS status_code, coalesce(v, '') AS value FROM probes LEFT JOIN m ON probes.key = m.key",
        "kv_get_levels": f"{best} SELECT probes.key, CASE WHEN coalesce(v, '') = '' THEN 1 ELSE 0 END AS status_code, coalesce(v, '') AS value, strlen(coalesce(v, '')) AS val_len, coalesce(level_rank, -1) AS level_rank FROM probes LEFT JOIN m ON probes.key = m.key",
        "kv_exists_semi": f"{best} SELECT key FROM probes SEMI JOIN m USING (key)",
        "kv_missing_anti": f"{best} SELECT key FROM probes ANTI JOIN m USING (key)",
        "kv_get_batch_all": f"{best_all} SELECT probes.key, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS status_code, coalesce(v, '') AS value FROM probes LEFT JOIN m ON probes.key = m.key",
        "kv_get_levels_all": f"{best_all} SELECT probes.key, CASE WHEN coalesce(v, '') = '' THEN 1 ELSE 0 END AS status_code, coalesce(v, '') AS value, strlen(coalesce(v, '')) AS val_len, coalesce(level_rank, -1) AS level_rank FROM probes LEFT JOIN m ON probes.key = m.key",
        "kv_exists_semi_all": f"{best_all} SELECT key FROM probes SEMI JOIN m USING (key)",
        "kv_missing_anti_all": f"{best_all} SELECT key FROM probes ANTI JOIN m USING (key)",
        "kv_round_robin": "SELECT event_id, CAST(event_id % 4 AS INTEGER) AS worker FROM events",
        "kv_frame_decode": f"WITH {logs.CMDS} SELECT cmd_type, CAST(strlen(key) AS INTEGER) AS key_len, CAST(strlen(coalesce(value, '')) AS INTEGER) AS val_len, CAST(0 AS BIGINT) AS client_id, seq AS request_id, key, coalesce(value, '') AS value FROM cmds",
        "kv_limits": """SELECT why, count(*) AS commands, CAST(sum(n) AS BIGINT) AS value_bytes FROM (SELECT CASE WHEN strlen('doc_' || CAST(doc_id AS VARCHAR)) > 255 THEN 'key_too_long' WHEN strlen(coalesce(text, '')) > 1024 THEN 'value_too_long' ELSE 'ok' END AS why, strlen(coalesce(text, '')) AS n FROM documents) GROUP BY why""",
        "kv_ack": f"WITH {logs.CMDS} SELECT 4 AS cmd_type, CAST(strlen(key) AS INTEGER) AS key_len, 0 AS val_len, seq % 4 AS client_id, seq AS request_id, {ack} AS header FROM cmds WHERE cmd_type = 2",
        "kv_wal_frames": f"WITH {logs.CMDS} SELECT seq, {frame} AS frame FROM cmds WHERE cmd_type = 2",
        "kv_wal_batches": f"WITH {logs.CMDS}, n AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 1024 AS b FROM cmds WHERE cmd_type = 2) SELECT b, count(*) AS n, CAST(sum(20 + strlen(key) + strlen(value)) AS BIGINT) AS bytes FROM n GROUP BY b",
        "kv_sparse_index": f"WITH {logs.INDEX} SELECT key, off, pos FROM si",
        "kv_sparse_seek": f"WITH {logs.INDEX}, pr AS (SELECT 'o_' || CAST(i AS VARCHAR) AS key FROM range(0, 16000, 97) t(i) UNION ALL VALUES ('a'), ('zz')) SELECT pr.key, si.off FROM pr ASOF LEFT JOIN si ON pr.key >= si.key",
        "kv_sparse_seek_all": f"WITH {logs.INDEX}, pr AS (SELECT key FROM run UNION ALL SELECT key || 'x' FROM run UNION ALL VALUES ('a'), ('zz')) SELECT pr.key, si.off FROM pr ASOF LEFT JOIN si ON pr.key >= si.key",
        "kv_sstable_footer": f"""WITH {logs.INDEX}, d AS (SELECT count(*) AS n_keys, CAST(sum(8 + strlen(key) + strlen(value)) AS BIGINT) AS index_offset FROM run), x AS (SELECT CAST(sum(12 + strlen(key)) AS BIGINT) AS index_size FROM si)
SELECT n_keys, index_offset, index_size, index_offset + index_size AS bloom_offset, (greatest(n_keys * 10, 64) + 7) // 8 AS bloom_size FROM d, x""",
        "kv_sstable_scan": f"WITH {logs.RUN} SELECT key, value FROM run",
        "kv_flush_boundaries": f"WITH RECURSIVE {logs.FLUSH} SELECT gen, last_seq, bytes FROM f",
        "kv_flush_runs": f"""WITH RECURSIVE {logs.FLUSH}, g AS (SELECT gen, last_seq, lag(last_seq, 1, -1) OVER (ORDER BY gen) AS before FROM f),
l AS (SELECT gen, key, arg_max(value, seq) AS value FROM puts JOIN g ON seq > before AND seq <= last_seq GROUP BY gen, key)
SELECT gen, 'table_' || CAST(gen AS VARCHAR) || '.sst' AS file, count(*) AS n_keys, CAST(sum(strlen(key) + strlen(value)) AS BIGINT) AS bytes, CAST(sum(strlen(key) + strlen(value)) // 50 + 100 AS BIGINT) AS bloom_keys, min(key) AS min_key, max(key) AS max_key FROM l GROUP BY gen""",
        "kv_level_set": f"""WITH RECURSIVE {logs.FLUSH}, t AS (SELECT max(gen) AS last, greatest(0, (max(gen) - 1) // 3) AS c FROM f)
SELECT last - gen AS level_rank, 'table_' || CAST(gen AS VARCHAR) || '.sst' AS file FROM f, t WHERE gen > CASE WHEN c > 0 THEN 1 + 3 * c ELSE 0 END
UNION ALL SELECT last - (1 + 3 * c), 'table_compacted_' || CAST(c AS VARCHAR) || '.sst' FROM t WHERE c > 0""",
    }
