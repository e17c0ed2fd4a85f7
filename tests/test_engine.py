import pytest
from pyspark.sql import functions as F

from siltbed.functions import hashing, wire
from siltbed.operators import lookup, positions, runs, upsert
from siltbed.sources import wal
from siltbed.streaming import ingest

LOG = "seq long, key string, cmd_type int, value string"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_upsert_delete_and_empty_key(spark):
    log = spark.createDataFrame([(0, "a", 2, "1"), (1, "b", 2, "2"), (2, "c", 2, "3"), (3, "a", 2, "9"), (4, "b", 2, ""), (5, "c", 3, None), (6, "", 2, "x"), (7, "z", 9, "?")], LOG)
    state = upsert.last_writer_wins(log)
    assert rows(state, "key", "value") == [("", "x"), ("a", "9"), ("b", ""), ("c", "")]
    assert rows(upsert.live(state), "key", "value") == [("", "x"), ("a", "9")]
    assert upsert.last_writer_wins(log.limit(0)).count() == 0


def test_merge_hides_older_values(spark):
    r = spark.createDataFrame([(0, "a", "9"), (0, "b", ""), (1, "a", "1"), (1, "b", "2"), (1, "c", "3")], "run_idx int, key string, value string")
    assert rows(upsert.live(upsert.kway_merge(r)), "key", "value", "src_run") == [("a", "9", 0), ("c", "3", 1)]


def test_bytewise_order_and_limits(spark):
    keys = ["", "Z", "key_10", "key_2", "z", "é", "￮", "\U0001f600"]
    df = spark.createDataFrame([(k,) for k in reversed(keys)], "key string")
    assert [r.key for r in positions.with_positions(df, [F.col("key")]).orderBy("pos").collect()] == keys
    t = spark.createDataFrame([("k" * 255, "v" * 1024), ("é" * 128, ""), ("k", "é" * 513)], "key string, value string")
    assert [r[0] for r in t.select(wire.limits(F.col("key"), F.col("value"))).collect()] == ["ok", "key_too_long", "value_too_long"]


def test_flush_fold_matches_load_script(spark):
    log = spark.range(5000).select(F.col("id").alias("seq"), F.concat(F.lit("KEY_"), "id").alias("key"), F.lit(2).alias("cmd_type"), F.repeat(F.concat(F.lit("HFT_TICK_DATA_"), "id", F.lit("_")), 5).alias("value"))
    got = rows(runs.flush_boundaries(log), "gen", "last_seq", "bytes")
    assert [g[1] for g in got] == [682, 1337, 1974, 2611, 3248, 3885, 4522] and [g[2] for g in got] == [65591, 65563] + [65611] * 5


def test_equal_overwrites_never_flush(spark):
    log = spark.range(3000).select(F.col("id").alias("seq"), F.lit("k").alias("key"), F.lit(2).alias("cmd_type"), F.lit("v" * 100).alias("value"))
    assert runs.flush_boundaries(log).count() == 0


def test_level_set(spark):
    for n, want in ((3, ["table_1.sst", "table_2.sst", "table_3.sst"]), (4, ["table_compacted_1.sst"]), (6, ["table_5.sst", "table_6.sst", "table_compacted_1.sst"]), (7, ["table_compacted_2.sst"])):
        assert sorted(r.file for r in runs.level_set(spark.range(1, n + 1).withColumnRenamed("id", "gen")).collect()) == want


def test_compaction_needs_four(spark):
    m = spark.range(5).withColumnRenamed("id", "level_rank")
    assert rows(upsert.compaction_plan(m), "level_rank") == [(1,), (2,), (3,), (4,)]
    assert upsert.compaction_plan(m.where("level_rank < 3")).count() == 0


def test_seek(spark):
    run = spark.createDataFrame([(f"k{i:04}", "v") for i in range(200)], "key string, value string")
    got = dict(rows(runs.sparse_seek(runs.sparse_index(run), spark.createDataFrame([("a",), ("k0063",), ("k0064",), ("z",)], "key string")), "key", "off"))
    assert got == {"a": None, "k0063": 0, "k0064": 64 * 14, "z": 192 * 14}


def test_lookups(spark):
    levels = spark.createDataFrame([(1, "a", "old"), (0, "a", "new"), (0, "b", "")], "level_rank int, key string, value string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert rows(lookup.get_batch(asked, levels), "key", "status_code", "value") == [("a", 0, "new"), ("b", 0, ""), ("c", 1, "")]
    assert rows(lookup.get_batch(asked, levels, logical=True), "key", "status_code") == [("a", 0), ("b", 1), ("c", 1)]


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(i, f"k{i % 7}", 2, f"v{i}") for i in range(100)] + [(100, "big", 2, "x" * 2000)], LOG)
    log.repartition(3).write.parquet(f"{tmp_path}/in")
    ingest.append(ingest.commands(spark, log.schema, f"{tmp_path}/in", 1), f"{tmp_path}/out", f"{tmp_path}/state")
    good = spark.read.parquet(f"{tmp_path}/out/log")
    assert good.count() == 100 and spark.read.parquet(f"{tmp_path}/out/quarantine").count() == 1
    q = ingest.upserted(ingest.commands(spark, log.schema, f"{tmp_path}/in", 1).where("key <> 'big'")).writeStream.format("memory").queryName("state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("state"), "key", "value", "seq") == rows(upsert.last_writer_wins(good), "key", "value", "seq")
    wal.append(good, f"{tmp_path}/wal")
    assert rows(wal.replay(spark, f"{tmp_path}/wal"), "key", "value", "seq") == rows(upsert.last_writer_wins(good), "key", "value", "seq")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_lookups_over_whole_tables(spark, sf):
    import __spark_entry__ as e

    d, q = f"/root/testdata/{sf}", e.queries()
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct().count()
    written = spark.read.parquet(f"{d}/events.parquet").where("event_type <> 'view'").select("user_id").distinct().count()
    orders = spark.read.parquet(f"{d}/orders.parquet").count()
    assert q["kv_get_batch_all"](spark, d).where("status_code = 0").count() == written
    assert q["kv_get_levels_all"](spark, d).count() == 2 * users
    assert q["kv_exists_semi_all"](spark, d).count() == written and q["kv_missing_anti_all"](spark, d).count() == 2 * users - written
    assert q["kv_sparse_seek_all"](spark, d).count() == 2 * orders + 2


def test_bloom_fits_its_run(spark):
    import __spark_entry__ as e

    d, q = "/root/testdata/sf0.1", e.queries()
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    size = hashing.bloom_bytes(n)
    ones = q["kv_bloom_build"](spark, d).agg(F.sum(F.bit_count("byte"))).first()[0]
    assert 0.4 < ones / (8 * size) < 0.6  # half of the bits at 10 bits a key and 7 probes
    assert q["kv_bloom_bits"](spark, d).agg(F.max(F.array_max("bits"))).first()[0] > 0.99 * 8 * size


def test_bloom_probe_holds_no_filter_on_the_driver(spark, monkeypatch):
    import __spark_entry__ as e

    from pyspark.sql.classic.dataframe import DataFrame

    taken, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(collect(self)) or taken[-1])
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda bits: pytest.fail("the filter was broadcast"))
    got = rows(e.queries()["kv_bloom_probe"](spark, "/root/testdata/sf0.01"), "present", "n", "maybe")
    assert all(len(t) <= 2 for t in taken)  # was one row for each byte of the filter
    keys = [f"o_{r[0]}".encode() for r in spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey").toLocalIterator()]
    plain = hashing.bloom_probe(hashing.bloom_build(keys), [k + b"x" for k in keys])
    assert got == [(False, len(keys), int(plain.sum())), (True, len(keys), len(keys))]


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_bloom_probe_over_many_segments(spark, monkeypatch, n):
    """More segments than probes, fewer, and one; repeated keys, empty ones and such as are no ASCII."""
    keys = [f"k{i % 2500}" if i % 9 else "" if i % 2 else f"é{i}" for i in range(n)]
    asked = [(k, True) for k in keys] + [(k + "x", False) for k in keys]
    bits = hashing.bloom_build([k.encode() for k in keys], n)
    want = sorted((t, sum(hashing.bloom_probe(bits, [k.encode() for k, u in asked if u == t]).tolist())) for t in {t for _, t in asked})
    df, asked = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(asked, "key string, present boolean")
    for piece, segment in ((1 << 16, 1 << 22), (64, 256), (64, 2048)):
        monkeypatch.setattr(hashing, "PIECE", piece)
        monkeypatch.setattr(hashing, "SEGMENT", segment)
        monkeypatch.setattr(hashing, "GATHER", 700)
        assert rows(hashing.maybe_held(df, n, asked, "present"), "present", "maybe") == want
