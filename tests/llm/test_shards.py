"""Sharding: laws, classes of equal texts, written files."""

import collections
import random
import zlib

from pyspark.sql import functions as F

from siltbed.llm import shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, crc string, row int"
rng = random.Random(8)


def table(spark):
    hot = "copied text " * 9
    rows = [(i, hot if i % 3 == 0 else f"text {i % 200} é", rng.choice(["en", "de", None]), rng.choice(["a", "b", "c"])) for i in range(700)]
    rows += [(None, None, None, None), (None, hot, "en", "a"), (7, "", "en", "a"), (7, "", "en", "a"), (7, "", "en", "a"), (800, "x" * 300_000, "en", "z")]
    return rows, spark.createDataFrame([(*r, 0, 9, "s", "c", 3) for r in rows], SCHEMA).repartition(5)


def test_rows_sizes_checksums_and_slots(spark):
    rows, docs = table(spark)
    got = shards.assign(docs).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_equal_texts_lie_together(spark):
    _, docs = table(spark)
    got = sorted(shards.assign(docs).collect(), key=lambda r: (r.shard, r.slot))
    order = [(r["size"], r.text_crc32) for r in got]
    changes = 1 + sum(a != b for a, b in zip(order, order[1:]))
    assert changes == len(set(order))  # each class is one run of the whole order
    held = collections.defaultdict(set)
    for r in got:
        held[r["size"], r.text_crc32].add(r.shard)
    assert all(max(v) - min(v) + 1 == len(v) for v in held.values()) and sum(len(v) > 1 for v in held.values()) <= 15


def test_more_shards_than_rows_and_no_rows(spark):
    _, docs = table(spark)
    few = shards.assign(docs.where("doc_id < 5")).collect()
    assert len({r.shard for r in few}) == 5 and {r.slot for r in few} == {0}
    assert shards.assign(docs.limit(0)).count() == 0


def test_written_files(spark, tmp_path):
    rows, docs = table(spark)
    name = shards.write(docs, f"{tmp_path}/out", 4)
    assert name == "shard_"
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.columns == [*docs.columns, "shard_"]
    assert collections.Counter((r.doc_id, r.text, r.lang, r.source) for r in got.collect()) == collections.Counter(rows)
    counts = [r["count"] for r in got.groupBy("shard_").count().collect()]
    assert len(counts) == 4 and max(counts) - min(counts) <= 1
    assert got.where(F.col("shard") != 9).count() == 0
