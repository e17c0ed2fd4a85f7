"""The n-gram Jaccard join: large clusters, limits, and the pairs that it verifies."""

import random

import numpy as np
import pytest

import plain
from siltbed.llm import common, jaccard


rng = random.Random(21)


def near_copies(n, words=90, edits=3, seed=1):
    r = random.Random(seed)
    base = [f"v{i}" for i in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = f"x{r.randrange(100_000)}"
        out.append(" ".join(w))
    return out


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)


def components(docs, n, percent):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, n, percent, counts=False).collect()}


def expected(texts, n, percent):
    sets = plain.word_sets(texts, n)
    return {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, plain.groups(list(range(len(texts))), sets, percent)))}


MIXED = near_copies(150) + near_copies(60, 60, 8, 2) + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["", None, "x", "x", "A b  C", "a b c"]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80), (4, 100), (3, 60)])
def test_components(spark, n, percent):
    assert components(table(spark, MIXED), n, percent) == expected(MIXED, n, percent)


def test_hot_signatures_are_dealt_out(spark, monkeypatch):
    for name, value in (("HEAD", 2), ("LARGE", 2), ("SPLIT", 3), ("FAIR", 0)):
        monkeypatch.setattr(jaccard, name, value)
    assert components(table(spark, MIXED), 4, 85) == expected(MIXED, 4, 85)


def test_large_groups_of_unlike_sets(spark, monkeypatch):
    """Documents of passages that many share: groups are large, but links few."""
    monkeypatch.setattr(jaccard, "LARGE", 3)
    r = random.Random(4)
    passages = [" ".join(f"p{k}_{i}" for i in range(12)) for k in range(25)]
    texts = [" ".join([*r.sample(passages, 3), *(f"u{i}_{k}" for k in range(r.choice([0, 0, 40])))]) for i in range(150)]
    texts += [t.replace("u3_", "w") for t in texts[:20]] + [t + " tail" for t in texts[:30]]
    assert components(table(spark, texts), 4, 85) == expected(texts, 4, 85)


def test_work_is_linear_in_a_cluster(spark):
    """Of distinct near copies few more pairs are verified than there are sets."""
    for n in (500, 1000):
        texts = near_copies(n, 120, 4)
        done = jaccard.work(table(spark, texts), 4, 85)
        sets = len(set(texts))
        assert sets > 0.9 * n and sum(done["rounds"]) + done["rest"] <= 5 * sets


def test_links_are_counted_on_demand(spark):
    texts = near_copies(40) + ["same words here again"] * 3
    sets = plain.word_sets(texts, 4)
    want = {i: sum(100 * len(s & t) >= 85 * len(s | t) for j, t in enumerate(sets) if j != i) for i, s in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in jaccard.join(table(spark, texts), 4, 85).collect()} == want


def test_components_over_several_tasks(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + r.randint(1, 200)) for _ in range(300)] + [(5000 + r.randrange(60), 5000 + r.randrange(60)) for _ in range(80)]
    names = sorted({x for e in edges for x in e})
    uf = common.UnionFind()
    for a, b in edges:
        uf.union(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    want = {x: uf.find(x) for x in names if x in linked}
    frame = spark.createDataFrame(edges, "u long, v long")
    for local in (10, 10_000):
        assert {r.node: r.component for r in common.components(frame, local=local).collect()} == want


def test_columns_with_clashing_names(spark):
    texts = near_copies(6) + [None, ""]
    names = "doc_id long, text string, fp string, sig string, _keep int, _keep_hash int, _ int, thash string"
    docs = spark.createDataFrame([(i, t, "f", "s", i, 7, 8, "t") for i, t in enumerate(texts)], names)
    got = jaccard.deduplicated(docs, 4, 85)
    assert got.columns == docs.columns
    first = {g for _, g in expected(texts, 4, 85).values()}
    assert sorted((r.doc_id, r._keep, r.fp) for r in got.collect()) == sorted((i, i, "f") for i in first)


def test_buckets_follow_the_files(spark, tmp_path, monkeypatch):
    """Files count, tables without a known size don't, however wide the rows that a projection leaves out."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wide = spark.createDataFrame([(1, "a", *[None] * 20)], "doc_id long, text string, " + ", ".join(f"c{k} string" for k in range(20)))
    assert common.buckets(wide.select("doc_id", "text").where("doc_id is not null")) == own
    spark.range(100_000).selectExpr("id as doc_id", "sha2(string(id), 256) as text").write.parquet(f"{tmp_path}/t")
    files = spark.read.parquet(f"{tmp_path}/t")
    assert common.buckets(files) == own
    monkeypatch.setattr(common, "BUCKET", 1 << 18)
    assert own < common.buckets(files.where("doc_id > 5").select("doc_id")) == common.buckets(files) < 200


@pytest.mark.parametrize("edits, most", [(2, 2), (4, 5)])
def test_few_pairs_are_verified_in_a_cluster_of_sets_that_all_differ(spark, edits, most):
    """As test_work_is_linear_in_a_cluster, of texts that all differ; without tails a sixth of them are
    equal. With up to 2 edits the cluster is one component; with 4 most sets link with none, and the
    pairs that the sketches leave grow faster than the sets (482, 1850, 7264, 30150 of 500 to 4000)."""
    for n in (500, 1000, 2000):
        texts = [f"{t} tail{i}" for i, t in enumerate(near_copies(n, 120, edits))]
        done = jaccard.work(table(spark, texts), 4, 85)
        assert sum(done["rounds"]) + done["rest"] <= most * n, (n, done)


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.sort(r.choice(pool, k, replace=False)) for k in r.integers(0, 900, 1500)]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    bits = jaccard.sketches(np.concatenate(sets), edges)
    assert bits.shape == (1500, len(jaccard.WORDS))
    for a, b in r.integers(0, 1500, (500, 2)):
        apart = sum(int(x).bit_count() for x in (bits[a] ^ bits[b]).view(np.uint64))
        assert apart <= len(np.setxor1d(sets[a], sets[b])) and (a != b or apart == 0)


def test_a_full_map_of_wanted_sets_loses_none(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MAP", 64)
    assert components(table(spark, MIXED), 4, 85) == expected(MIXED, 4, 85)


def test_settled_frames_leave_no_shuffle_files(spark):
    """Once its rows are in the checkpoint folder, the shuffles that made them go, and only they."""
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    other = spark.range(1000).repartition(3, "id").selectExpr("id", "id % 7 as k").rdd
    other.count()
    held = lambda: {k for k in range(newest + 50) if tracker.containsShuffle(k)}
    newest = spark.sparkContext._jsc.sc().newShuffleId()
    before = held()
    df = spark.range(1000).selectExpr("id", "id % 7 as k").repartition(3, "k").groupBy("id").count()
    done = common.settled(df.repartition(4, "id"))
    assert held() <= before and done.count() == done.select("id").distinct().count() == 1000
    assert done.rdd.getNumPartitions() == 4 and other.count() == 1000


def test_sets_of_many_pairs_are_dealt_out(spark, monkeypatch):
    """Pairs of sets on both sides of SPLIT, each verified once."""
    texts = near_copies(60, 60, 6)
    sets = plain.word_sets(texts, 4)
    docs = table(spark, texts)
    for split in (1, 4, 256):
        monkeypatch.setattr(jaccard, "SPLIT", split)
        names = jaccard.members(docs, 4).select("doc_id", "fp")
        fp = {r.doc_id: r.fp for r in names.collect()}
        pairs = sorted({(fp[i], fp[j]) for i in range(60) for j in range(8) if fp[i] != fp[j] and i % 8 <= j})
        text_of = jaccard.texts_of(docs, names.select("fp").distinct(), 4)
        got = sorted(map(tuple, jaccard.verified(spark.createDataFrame(pairs, "a long, b long"), text_of, 4, 85).collect()))
        own = {fp[i]: s for i, s in enumerate(sets)}
        assert got == [(a, b, 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])) for a, b in pairs]
