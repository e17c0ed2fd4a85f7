"""Against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra
columns; and on empty tables."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltbed.llm import bpe, common, decontaminate, fingerprint, jaccard, langid, licences, lines, quality, repeats, shards

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, bucket int"
SF = "/root/testdata/sf0.001"
rng = random.Random(5)
VOCAB = ["wa", "ber", "é", "Licensed", "of", "the", "CC", "BY", "All", "rights", "reserved", "a1", "ñ", "😀"] + [f"w{i}" for i in range(60)]


def sentence(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [sentence(rng.randint(30, 90)) for _ in range(12)]
    out = []
    for i in range(60):
        parts = [rng.choice(base) if rng.random() < 0.5 else sentence(rng.randint(1, 50)) for _ in range(rng.randint(1, 4))]
        out.append((i, "\n".join(parts)))
    out += [(60, None), (61, ""), (62, "x"), (63, "a" * 30_000), (64, out[3][1]), (64, out[3][1]), (65, "\n\n"), (66, "ab" * 900 + "\n" + sentence(4000))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1) for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, rows, none):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.tokenizer(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks, special_tokens={})
    want = sorted((i, hashlib.sha256(",".join(map(str, enc.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, path, P.PATTERN).collect()) == want
    assert bpe.digests(none, path, P.PATTERN).count() == 0
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN), path, P.PATTERN)
    assert sorted((r.doc_id, bytes(r.bytes)) for r in got.collect()) == sorted((i, (t or "").encode()) for i, t in rows)


def linked(rows, n, percent):
    """Per row: id, set size, component, links with other rows."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())))
    uf, links = common.UnionFind(), collections.Counter()
    for k, (a, x) in enumerate(sets):
        for m, (b, y) in enumerate(sets[:k]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                uf.union(a, b)
                links.update((k, m))
    return sorted((i, len(s), uf.find(i), links[k]) for k, (i, s) in enumerate(sets))


def joined(docs, n, percent):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.join(docs, n, percent).collect())


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_join(docs, rows, none, n, percent):
    assert joined(docs, n, percent) == linked(rows, n, percent)
    assert jaccard.join(none, n, percent).count() == 0


def test_join_without_ids(spark):
    """Rows without an id link with nothing, so they can't join two others."""
    w = [f"v{i}" for i in range(60)]
    texts = [" ".join(w[:54]), " ".join(w[:57]), " ".join(w[:60])]
    whole = spark.createDataFrame(list(zip([4, 5, 6], texts)), "doc_id long, text string")
    assert joined(whole, 4, 93) == [(4, 51, 4, 1), (5, 54, 4, 2), (6, 57, 4, 1)]
    torn = spark.createDataFrame(list(zip([4, None, 6], texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join(torn, 4, 93).collect()}
    assert got == {4: (4, 0), None: (None, 0), 6: (6, 0)}


def test_deduplicated_repeated_ids(spark):
    """Two texts of one id are two documents: a copy goes, its namesake stays."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (7, a, "y"), (7, b, "z"), (7, b, "z"), (None, a, "n"), (8, None, "e"), (9, "", "f")]
    got = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, thash string"))
    assert got.columns == ["doc_id", "text", "thash"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a, "x"), (7, b, "z"), (None, a, "n"), (8, None, "e"), (9, "", "f")], key=str)


def test_join_of_frequent_shingles(spark):
    """120 near copies: their shingles are all frequent, so pairs of them are indexed."""
    words = [f"v{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(80)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, sentence(60)) for i in range(30)] + [(300 + i, " ".join(words[: 6 + i])) for i in range(8)]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85) == linked(rows, 4, 85)


def test_fingerprints(docs, rows, none):
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: r[0])
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        if i != 64:
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert got[64].fingerprint == got[3].fingerprint and fingerprint.fingerprints(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(i, " ".join(f"q{rng.randrange(500)}" for _ in range(30))) for i in range(6)] + [(9, None), (10, "of the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    edited = items[1][1].split()
    edited[4:6], edited[20] = ["of", "the"], "new"
    dirty = spark.createDataFrame([(100, sentence(50) + " " + items[0][1]), (101, " ".join(edited).upper() + "! " + sentence(40))], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(dirty)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(both, bench).collect()) == [(100, 0), (101, 1)]
    assert decontaminate.clean(both, bench).count() == docs.count()
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_a_widely_leaked_item(spark):
    r = random.Random(3)
    item = [f"q{i}" for i in range(40)]
    rows = [(i, " ".join(item)) for i in range(200)] + [(i, " ".join(f"z{r.randrange(300)}" for _ in range(50))) for i in range(200, 600)]
    for i in range(600, 640):  # edited by 10 to 20 %
        edited = list(item)
        for k in r.sample(range(40), r.randint(4, 8)):
            edited[k] = f"z{r.randrange(300)}"
        rows.append((i, " ".join(edited)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.contaminated(docs, bench).collect()} == {*range(200), *range(600, 640)}
    assert {x.doc_id for x in decontaminate.clean(docs, bench).collect()} == set(range(200, 600))


def test_decontamination_without_spaces(spark):
    items = ["春天的风吹过山谷带来远方的消息", "雨の夜に静かな港町を歩いていた", "แมวตัวนั้นนอนอยู่บนหลังคาบ้าน", "𠀀𠀁𠀂𠀃𠀄𠀅"]
    around = ["他们说", "そして", "ครับ", "𠁀𠁁"]
    rows = [(k, a + t + a) for k, (t, a) in enumerate(zip(items, around))] + [(10, "春天的风吹过高原带来远方的消息"), (11, "他们说今天不下雨"), (12, "plain words of no item é")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(0, 0), (1, 1), (2, 2), (3, 3), (10, 0)]
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {11, 12}


def test_quality(spark, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = quality.fit(docs, labels, out)
    got = quality.score(docs, model, out).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x\n" * 5000)], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model, out).collect()) and quality.score(none, model, out).count() == 0
    assert quality.fit(docs, labels.limit(0), out) is None and {r.score for r in quality.score(odd, None, out).collect()} == {0.5}


def test_field_marginals():
    r = np.random.default_rng(1)
    node, edge = r.normal(size=(5, 2)), r.normal(size=(2, 2))
    total, good = 0.0, np.zeros(5)
    for k in range(32):
        y = [k >> i & 1 for i in range(5)]
        p = np.exp(sum(node[i, y[i]] for i in range(5)) + sum(edge[y[i], y[i + 1]] for i in range(4)))
        total, good = total + p, good + p * np.array(y)
    assert np.allclose(quality.marginals(node, edge, np.array([5]))[:, 1], good / total)


def test_repeats(docs, rows, none):
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(b[k : k + 100])
        want[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(docs).collect()} == want
    assert repeats.digests(docs).count() == len(rows) and repeats.digests(none).count() == 0


def test_shards(docs, rows, none):
    got = shards.assign(docs).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and shards.assign(none).count() == 0
    grid = np.array([(a, b) for a in range(8) for b in range(8)])
    path = grid[np.argsort(shards.hilbert(grid, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards_of_long_common_prefixes(spark):
    rows = [(i, "t", "en", f"https://example.org/source_{i * 7 % 16:02}" if i % 9 else None, 1) for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    limits = shards.string_limits(shards.keys(docs), "d_source", 960, 16)
    assert limits[0] is None and len(set(limits)) == 15
    got = collections.defaultdict(set)
    source = {r[0]: r[3] for r in rows}
    for r in shards.assign(docs).collect():
        got[r.shard].add(source[r.doc_id])
    assert np.mean([len(v) for v in got.values()]) <= 9  # all 17 where the source doesn't count


def test_lines(docs, rows, none):
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[lines.line_key(x)].add(i)
    want = {}
    for i, t in rows:
        every = (t or "").split("\n")
        left = [x for x in every if not (len(k := lines.line_key(x)) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != i)]
        want[i] = (len(every), len(every) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.digests(docs).collect()} == want
    assert lines.digests(none).count() == 0 and lines.applied(docs).columns == docs.columns


def test_licences(docs, rows, none):
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    got = {r.doc_id: r for r in licences.scan(docs).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low))
        at = [k for p in ("cc by", "general public license", "all rights reserved") for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert licences.scan(none).count() == 0


def test_language(spark, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~out))
    got = langid.predict(docs, model, out).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "12 !")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.predict(odd, model, out).collect()} == {"und"} and langid.predict(none, langid.fit(none), out).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 7), (200, 201), (203, 201)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 0, 200: 200, 201: 200, 203: 200}


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.where("not round_trip").count() == 0
