"""The stages of the pipeline against plain versions, and the cases that they define."""

import random

import plain
import pytest

import corpus_pipeline as pipeline
from siltbed.llm import bpe

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that stages use for columns of their own, or might.
CLASHING = "shard int, row string, keep int, name string, hash string, thash long, fp long, sig long, bucket int, kind int, blob binary, _id int, _keep int, _thash int, quality int, doc int, is_null string"
STAGES = dict(pipeline.STAGES)
rng = random.Random(17)


def prose(n, r=rng):
    return " ".join(f"{r.choice('abcdefghijk')}o{r.choice('lmnrst')}{r.randrange(90)}" for _ in range(n))


@pytest.fixture(scope="module")
def planted():
    """Good prose, junk, copies, near copies, shared lines and benchmark items, by doc_id."""
    rows, labels = [], []
    items = [(k, prose(30)) for k in range(4)]
    shared = ["This line is one that very many of the documents have in common.", "another of these lines, in which nothing is said either, again"]
    base = [prose(70) + ".\n" + prose(60) + "." for _ in range(12)]
    for i in range(120):
        t = prose(rng.randint(40, 90)) + ".\n" + prose(30) + "."
        if i % 6 == 0:
            t += "\n" + rng.choice(shared)
        rows.append((i, t))
        labels.append((i, 1, 0))
    for i in range(200, 240):
        rows.append((i, "\n".join("!!! $$$ >>> BUY || NOW" * rng.randint(1, 3) for _ in range(6))))
        labels.append((i, 0, 0))
    for i in range(300, 336):
        w = base[i % 12].split(" ")
        if i >= 312:
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    for i in range(400, 408):
        rows.append((i, prose(50) + ". " + items[i % 4][1] + ". " + prose(20) + "."))
    rows.append((500, prose(9000) + "."))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], labels, items


@pytest.fixture(scope="module")
def folder(spark, planted, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    rows, labels, items = planted
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_whole_run_against_plain_versions(spark, planted, folder):
    rows, labels, items = planted
    bad = {i for i, q, _ in labels if q == 0}
    after = [(i, t) for i, t, *_ in rows if i not in bad]
    after = plain.line_dedup(after)
    sets = plain.word_sets([t for _, t in after], 5)
    first = plain.groups([i for i, _ in after], sets, 80)
    after = [(i, t) for (i, t), f in zip(after, first) if i == f]
    assert {300 + k for k in range(12)} <= {i for i, _ in after} and not any(312 <= i < 336 for i, _ in after)
    words = lambda t: plain.re.findall(r"[a-z0-9]+", t.translate(plain.LOW))
    after = [(i, t) for i, t in after if not any(" ".join(words(x)) in " ".join(words(t)) for _, x in items)]
    tokens = bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks, special_tokens={})
    got = pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id, tuple(r.ids), r.n_tokens, r.round_trip) for r in got) == sorted((i, tuple(enc.encode_ordinary(t)), len(enc.encode_ordinary(t)), True) for i, t in after)


def odd(spark, planted):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns of clashing names."""
    rows = [(*r, *[None] * 17) for r in planted[0][:60]]
    rows += [(*[None] * 5, *[None] * 17)] * 2 + [(600, None, None, None, None, *[None] * 17), (601, "", "", "", 0, *[None] * 17), (601, "", "", "", 0, *[None] * 17)]
    rows += [(None, planted[0][0][1], "en", "s", 5, *[None] * 17), (602, planted[0][1][1], "en", "s", 5, *[None] * 17), (602, planted[0][1][1], "en", "s", 5, *[None] * 17), (602, prose(60) + ".", "de", None, None, *[None] * 17)]
    rows += [(603, "long " + prose(30_000), "en", "s", None, *[None] * 17), (604, "\n" * 5000, "en", "s", 5000, *[None] * 17), (605, "x" * 100_000, "en", "s", None, *[None] * 17)]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASHING}").repartition(4)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_odd_rows(spark, planted, folder, name):
    docs = odd(spark, planted)
    out = STAGES[name](spark, docs, folder)
    if name == "encoding":
        assert out.count() == docs.count() and out.where("not round_trip").count() == 0 and out.where("doc_id = 601 and n_tokens = 0").count() == 2
        return
    assert out.schema.simpleString() == docs.schema.simpleString()
    got = [tuple(r) for r in out.collect()]
    before = [tuple(r) for r in docs.collect()]
    if name in ("quality_filter", "decontamination"):  # rows as they are; equal rows share their fate
        assert all(got.count(r) in (0, before.count(r)) for r in set(before)) and set(got) <= set(before)
    if name == "decontamination":
        assert sorted(got, key=str) == sorted(before, key=str)  # none holds an item
    if name == "line_dedup":
        want = dict.fromkeys(sorted((i is not None, i or 0, t or "") for i, t in plain.line_dedup([(-1 if r[0] is None else r[0], r[1]) for r in before]) for i in [None if i == -1 else i]))
        assert set((r[0] is not None, r[0] or 0, r[1] or "") for r in got) == set(want) and len(got) == len(before)
    if name == "near_duplicates":
        kept = [(r[0], r[1]) for r in got]
        assert kept.count((601, "")) == 1 and kept.count((None, None)) == 2 and (600, None) in kept and (None, planted[0][0][1]) in kept
        assert (602, planted[0][1][1]) not in kept and sum(i == 602 for i, _ in kept) == 1


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_empty_tables(spark, folder, name, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert STAGES[name](spark, none, folder).count() == 0
    for table, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{table}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if name in ("quality_filter", "decontamination"):
        assert STAGES[name](spark, docs, str(tmp_path)).count() == docs.count()


def test_work_folder_is_shared_or_refused(spark, monkeypatch):
    from siltbed.llm import common

    class Far:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://far:7077"})

    with pytest.raises(RuntimeError):
        common.shared_folder(Far)
    assert common.shared_folder(spark)


@pytest.mark.parametrize("named", [None, "hdfs://far/work"])
def test_work_folder_of_a_far_session(named):
    """The same of a session that has the setting, or hasn't, whatever this machine's defaults name."""
    from siltbed.llm import common

    class Far:
        conf = {"spark.checkpoint.dir": named}
        sparkContext = type("C", (), {"master": "spark://far:7077"})

    if named:
        assert common.shared_folder(Far) == named
    else:
        with pytest.raises(RuntimeError):
            common.shared_folder(Far)
