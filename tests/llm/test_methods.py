"""That results come by the methods named, and hold against plain versions."""

import collections
import hashlib
import math
import random

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from siltbed.llm import decontaminate, fingerprint, langid, licences, quality, repeats

rng = random.Random(33)
BASE = "doc_id long, text string"


def passages(n, size):
    return [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(size)) for _ in range(n)]


@pytest.fixture(scope="module")
def repeated():
    stock = passages(6, 60)
    rows = [(i, " ".join([*passages(1, rng.randint(1, 40)), rng.choice(stock), *passages(1, 20), rng.choice(stock)[: rng.randint(50, 300)]])) for i in range(60)]
    rows += [(100 + i, stock[0] + f" end {i} " + passages(1, 30)[0]) for i in range(40)]  # one passage, many continuations
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, "a\0" * 200 + "b"), (203, "\0" * 350), (204, None), (205, ""), (206, rows[3][1]), (206, rows[3][1]), (206, rows[4][1]), (207, "é" * 180)]
    return rows


def digests(docs, **options):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digests(docs, **options).collect())


def without_repeats(rows, length):
    named = sorted({(i, hashed(t), (t or "").encode()) for i, t in rows})
    gone = plain.removed_bytes([((i, h), b) for i, h, b in named], length)
    out = []
    for i, t in rows:
        b, g = (t or "").encode(), gone[i, hashed(t)]
        out.append((i, len(b), sum(g), len([x for x in bytes(g).split(b"\0") if x]), hashlib.sha256(bytes(c for c, x in zip(b, g) if not x)).hexdigest()))
    return sorted(out)


HASHES = {}


def hashed(text):
    return HASHES[text or ""]


@pytest.fixture(scope="module")
def repeated_docs(spark, repeated):
    docs = spark.createDataFrame(repeated, BASE).repartition(5)
    HASHES.update({r.t: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()})
    return docs


@pytest.mark.parametrize("length, hot", [(100, 1024), (100, 2), (400, 1024), (60, 4)])
def test_repeats_by_length_and_hot_anchors(repeated, repeated_docs, length, hot):
    assert digests(repeated_docs, length=length, hot=hot) == without_repeats(repeated, length)


def test_all_removals_come_from_the_interval_tree(repeated_docs, monkeypatch):
    none = np.empty(0, np.int64)
    monkeypatch.setattr(repeats, "maximal_repeats", lambda *a, **b: (none, none, none))
    assert {r[2] for r in digests(repeated_docs)} == {0}


def edited(words, share, r):
    out = list(words)
    for k in r.sample(range(len(out)), round(share * len(out))):
        out[k] = f"z{r.randrange(3000)}"
    return out


def test_recall_of_edited_items(spark):
    """Of items with 10 to 30 % of their words replaced at least 0.9 are found, and no clean document."""
    r = random.Random(9)
    vocabulary = [f"z{i}" for i in range(3000)]
    items = [[r.choice(vocabulary) for _ in range(r.randint(20, 60))] for _ in range(60)]
    rows, want = [], {}
    for share in (0.1, 0.2, 0.3):
        for k, item in enumerate(items):
            around = [r.choice(vocabulary) for _ in range(150)]
            want[len(rows)] = (k, share)
            rows.append((len(rows), " ".join(around[:70] + edited(item, share, r) + around[70:])))
    clean = [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(250))) for i in range(300)]
    bench = spark.createDataFrame(list(enumerate(" ".join(x) for x in items)), "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(rows + clean, BASE), bench).collect()}
    assert all(d < 1000 for d, _ in found)
    for share in (0.1, 0.2, 0.3):
        assert np.mean([(d, k) in found for d, (k, s) in want.items() if s == share]) >= 0.9
    assert len(found - {(d, k) for d, (k, _) in want.items()}) <= 0.02 * len(want)


def test_alignment_is_smith_waterman():
    r = random.Random(3)
    for _ in range(40):
        words = [f"w{r.randrange(12)}" for _ in range(r.randint(3, 25))]
        bench = decontaminate.Benchmark([(0, " ".join(words))])
        counts = np.array([r.randrange(50) for _ in range(len(bench.words.known) + len(bench.grams.known))])
        bench.weigh(60, counts)
        passage = np.array([r.randrange(-1, len(bench.words.known)) for _ in range(r.randint(1, 40))])
        item = bench.items[0]
        want = plain.smith_waterman(item.tolist(), passage.tolist(), bench.idf, decontaminate.GAP * float(bench.idf[item].mean()))
        assert math.isclose(bench.align(item, passage)[0], want, abs_tol=1e-9)


def test_items_of_few_words_are_found_as_whole_lines(spark):
    bench = spark.createDataFrame([(0, "Blue Moon"), (1, "zürich"), (2, "blue moon!"), (3, ""), (4, None)], "item_id long, text string")
    rows = [(0, "first line\n  blue, MOON.  \nlast"), (1, "a blue moon rose"), (2, "Zürich"), (3, "in Zürich\nblue\nmoon"), (4, None), (5, "blue moon\nblue moon")]
    docs = spark.createDataFrame(rows, BASE)
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.contaminated(docs, bench).collect()) == [(0, 0, 1.0), (0, 2, 1.0), (2, 1, 1.0), (5, 0, 1.0), (5, 2, 1.0)]
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {1, 3, 4}


def test_parts_of_items_with_common_seeds_only(spark):
    """An item whose first half stands in many documents is found by that half too."""
    r = random.Random(6)
    first, second = [f"k{i}" for i in range(20)], [f"m{i}" for i in range(12)]
    rows = [(i, " ".join(first)) for i in range(150)] + [(200 + i, " ".join(f"z{r.randrange(500)}" for _ in range(40))) for i in range(100)]
    bench = spark.createDataFrame([(0, " ".join(first + second))], "item_id long, text string")
    found = {x.doc_id for x in decontaminate.contaminated(spark.createDataFrame(rows, BASE), bench, 0.2).collect()}
    assert found == set(range(150))


def test_licences_hold_against_all_starts(spark):
    r = random.Random(12)
    templates = licences.BASE + licences.NOTICES
    filler = ["the", "and", "of", "software", "by", "to", "license", "any", "é", "42", "copy"]
    rows = [(0, None), (1, ""), (2, "cc by cc by nc All rights reserved"), (3, "CC-BY-SA 4.0; GNU General Public License, version 3")]
    for k in range(90):
        t = r.choice(templates)
        w = licences.split(t.text)
        for _ in range(r.randint(0, max(1, len(w) // 6))):
            what, at = r.random(), r.randrange(len(w))
            if what < 0.4:
                w[at] = r.choice(filler)
            elif what < 0.7:
                w.insert(at, r.choice(filler))
            elif len(w) > 2:
                del w[at]
        rows.append((10 + k, " ".join([*r.choices(filler, k=r.randint(0, 30)), *w, *r.choices(filler, k=r.randint(0, 10))]).title()))
    docs = spark.createDataFrame(rows, BASE).repartition(3)
    index = licences.Index(templates)
    n, counts = licences.frequencies(docs, index)
    held = collections.Counter(w for _, t in rows for w in set(licences.split(t or "")))
    assert n == len(rows) and all(counts.get(i, 0) == held[w] for i, w in enumerate(index.vocabulary))
    idf = {w: math.log((n + 1) / (held[w] + 1)) + 1 for w in index.vocabulary}
    got = {x.doc_id: x for x in licences.scan(docs).collect()}
    for i, t in rows:
        labels, base, starts, score = plain.licences(t, templates, idf, licences.COVERAGE, licences.MOST_SHIFT)
        x = got[i]
        assert (x.labels, x.base_labels, x.n_base) == (",".join(sorted(labels)), ",".join(sorted(base)), len(starts)), t
        assert (x.first_word, x.last_word) == (min(starts, default=None), max(starts, default=None))
        assert math.isclose(x.score, score, abs_tol=1e-5) and x.n_words == len(licences.split(t or ""))
    assert sum(bool(x.labels) for x in got.values()) > 50


def test_quality_gradient_is_that_of_one_objective():
    r = np.random.default_rng(5)
    per_doc, label = np.array([3, 1, 4, 2]), np.array([1, 0, 1, 1])
    z, weight, edge = r.normal(size=(10, 3)), r.normal(size=3), r.normal(size=(2, 2))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    balance = [0.5 / (label == k).mean() for k in (0, 1)]

    def objective(weight, edge):
        total = 0.0
        for d, y in enumerate(label):
            s = z[first[d] : first[d + 1]] @ weight
            score = lambda path: sum(s[i] / 2 * (1 if v else -1) for i, v in enumerate(path)) + sum(edge[a, b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            every = [score([k >> i & 1 for i in range(len(s))]) for k in range(1 << len(s))]
            total += balance[y] * (score([y] * len(s)) - np.log(np.exp(every).sum()))
        return total / len(z) - quality.L2 / 2 * ((weight**2).sum() + (edge**2).sum())

    g, h = quality.LineField.gradient(z, per_doc, label, weight, edge)
    for k in range(3):
        step = np.eye(3)[k] * 1e-5
        assert math.isclose((objective(weight + step, edge) - objective(weight - step, edge)) / 2e-5, g[k], abs_tol=1e-7)
    for k in range(4):
        step = np.eye(4)[k].reshape(2, 2) * 1e-5
        assert math.isclose((objective(weight, edge + step) - objective(weight, edge - step)) / 2e-5, h[k // 2, k % 2], abs_tol=1e-7)


def test_quality_fit_is_bounded_and_counts_an_id_once(spark, monkeypatch):
    seen = []
    real = quality.LineField.fit.__func__
    monkeypatch.setattr(quality.LineField, "fit", classmethod(lambda cls, x, per_doc, label: seen.append((len(x), len(per_doc))) or real(cls, x, per_doc, label)))
    docs = spark.createDataFrame([(i, "a good line.\n" * (i % 5) + "x") for i in range(40)] + [(3, "other")] * 50 + [(3, "an\nother")] * 50, BASE)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, labels, F.lit(False)) is not None and seen[-1][1] == 40
    assert quality.fit(docs, labels, F.lit(False), most_lines=30) is not None and seen[-1][0] <= 30


def sliding(text, rank):
    """Places of the selected features, span by span."""
    b = text.encode()
    n = len(b) - fingerprint.WINDOW + 1
    key = [(rank[plain.entropy_step(b[i : i + fingerprint.WINDOW])], i) for i in range(n)]
    wins = collections.Counter()
    for s in range(1 - fingerprint.SPAN, n):
        wins[min(key[max(0, s) : s + fingerprint.SPAN])[1]] += 1
    return sorted(i for i, w in wins.items() if w >= fingerprint.POPULAR)


def test_fingerprints_hold_against_plain_digests(spark):
    r = random.Random(7)
    texts = ["".join(r.choice("abcdefghij klmno\n") for _ in range(k)) for k in (0, 5, 31, 32, 40, 63, 64, 100, 400, 3000, 9000)] + ["a" * 300, None, "é" * 50]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, BASE).repartition(3)
    counts = np.zeros(fingerprint.STEPS, np.int64)
    for t in texts:
        b = (t or "").encode()
        for i in range(len(b) - fingerprint.WINDOW + 1):
            counts[plain.entropy_step(b[i : i + fingerprint.WINDOW])] += 1
    rank = fingerprint.ranks(fingerprint.surveyed(docs))
    assert (rank == fingerprint.ranked(counts)).all()
    got = {x.doc_id: x for x in fingerprint.fingerprints(docs).collect()}

    def bits(text):
        """The chain of filters as sets of bits."""
        b = np.frombuffer((text or "").encode(), np.uint8)
        if not len(b):
            return []
        poly = fingerprint.Polynomial(b)
        n = len(b) - fingerprint.WINDOW + 1
        h = poly.ranges(np.array([0]), np.array([len(b)])) if n <= 0 else poly.ranges(np.array(sliding(text, rank)), np.array(sliding(text, rank)) + fingerprint.WINDOW)
        h = list(dict.fromkeys(h.tolist()))
        return [{x >> 11 * k & 2047 for x in h[i : i + fingerprint.PER_FILTER] for k in range(5)} for i in range(0, len(h), fingerprint.PER_FILTER)]

    def alike(a, b):
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return float(not b)
        best = []
        for x in a:
            each = [(len(x & y) - len(x) * len(y) / 2048) / (min(len(x), len(y)) - len(x) * len(y) / 2048) if min(len(x), len(y)) > len(x) * len(y) / 2048 else 0.0 for y in b]
            best.append(max(each))
        return min(1.0, max(0.0, sum(best) / len(a)))

    for i, t in rows:
        t, nxt = t or "", texts[(i + 1) % len(texts)] or ""
        changed = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(t)
        assert int(got[i].fingerprint.split(":")[0]) == len(bits(t))
        assert math.isclose(got[i].near_edited, alike(bits(t), bits(changed)), abs_tol=1e-9)
        assert math.isclose(got[i].near_next, alike(bits(t), bits(nxt)), abs_tol=1e-9)


def test_fingerprints_of_a_hot_id(spark):
    """Many rows of one id or none, and repeated rows: each has its next."""
    texts = [f"text number {i} " * 8 for i in range(60)]
    rows = [(None, t) for t in texts] + [(5, t) for t in texts[:30]] + [(5, "same " * 20)] * 40 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, BASE).repartition(7)
    hashes = {r.text or "": r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""]))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        want[i, hashlib.sha256((t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]).encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in fingerprint.fingerprints(docs).collect()) == want


def test_language_distances(spark):
    """Out-of-place distances, gram by gram."""
    docs = spark.createDataFrame([(1, "la casa roja y la mesa", "es"), (2, "the red house and the table", "en"), (3, "das rote haus und der tisch", "de"), (4, "la maison", None)], BASE + ", lang string")
    profiles = langid.fit(docs, 30)
    model = langid.Profiles(profiles, 30)
    for text in ("la casa", "the house", "haus", "x", "ÀÉ the la"):
        gram, count = langid.grams(text)
        top = [g for _, g in sorted(zip((-count).tolist(), gram.tolist()))][:30]
        want = {}
        for name, own in profiles.items():
            place = {g: k for k, g in enumerate(own.tolist())}
            want[name] = sum(abs(place[g] - k) if g in place else 30 for k, g in enumerate(top))
        assert dict(zip(model.names, model.distances(np.array(top)).tolist())) == want
        assert model.predict(text)[0] == min(sorted(want), key=want.get)
