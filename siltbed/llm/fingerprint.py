"""Document fingerprints from improbable features.

Every WINDOW bytes of a text are a feature. Features are ranked by how rare their entropy is: the
entropy, in 1001 steps, gives the rank that its step has in the corpus's own distribution, rarest
first; nearly uniform runs of one byte (below WEAK steps) come last. A feature that is the leftmost
of the lowest rank in at least POPULAR of the SPAN spans of SPAN successive features that hold it is
selected; spans reach over both ends of a text, so every text has one. Selected features go, five bits
each, into Bloom filters of 2048 bits, PER_FILTER features to a filter, then the next of the chain.

Two digests are compared filter by filter: the bits that both have, less what chance would give, over
the most that they could have; each filter of the shorter digest takes its best partner, and the
means over filters is the likeness.

Documents are dealt to ranges of (doc_id, text hash) that hold about the same bytes, whose limits come
from the running sum of all documents' sizes. So neither one doc_id nor one text can fill a range with
more than its own distinct rows: rows equal in both go as one with their number.

Defined cases: null and empty texts have no features; texts shorter than WINDOW bytes are one
feature; digests without features are alike to each other (1) and unlike all others (0); rows are
ordered by doc_id (nulls first) and text hash, so repeated ids and rows have a next row too; after the
last comes the first, so a table of one row follows itself; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import EXCHANGE, FLUSH, Polynomial, batches, blobs_by_bucket, buckets, checkpointed, document_batches, exchanged, freeze, nullable_ids, runs, text_columns, thaw
from siltbed.operators.positions import with_positions

WINDOW, SPAN, POPULAR, WEAK = 32, 32, 8, 100
BITS, PER_FILTER = 2048, 128
STEPS = 1001

_COST = np.array([0] + [round(c * np.log2(c) * 65536) for c in range(1, WINDOW + 1)], np.int64)


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy, in steps of 0 to 1000, of the WINDOW bytes at each place."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int16)
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)  # equal bytes within WINDOW - 1
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    # what a window's sum of c * log2(c) gains with its next byte, and loses with its first
    gain = np.diff(_COST)
    sums = np.empty(n, np.int64)
    sums[0] = _COST[np.bincount(data[:WINDOW], minlength=1)].sum()
    sums[1:] = gain[before[WINDOW:]] - gain[after[: n - 1]]
    np.cumsum(sums, out=sums)
    high = np.log2(WINDOW)
    return np.rint((high - sums / (WINDOW * 65536)) * (1000 / high)).astype(np.int16)


def surveyed(docs: DataFrame) -> DataFrame:
    """(kind, a, b, c): of kind 0 doc_id, text hash and bytes of every document (once a task), of kind 1
    a step of entropy and its windows."""

    def run(it):
        total, known = np.zeros(STEPS, np.int64), set()
        for ids, _, thash, data, off in document_batches(it):
            for lo, hi in runs(off):
                e = entropies(data[off[lo] : off[hi]])
                o = off[lo : hi + 1] - off[lo]
                inside = np.ones(len(e), bool)
                for end in o[1:-1]:
                    inside[max(0, end - WINDOW + 1) : end] = False  # windows that cross into the next document
                total += np.bincount(e[inside], minlength=STEPS)
            fresh = [i for i, x in enumerate(zip(ids.tolist(), thash.tolist())) if x not in known and not known.add(x)]
            if len(known) > 1_000_000:
                known.clear()
            yield rows(np.zeros(len(fresh)), ids[fresh], thash[fresh], np.diff(off)[fresh])
        yield rows(np.ones(STEPS), np.arange(STEPS), total, np.zeros(STEPS))

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["kind", "a", "b", "c"])

    return checkpointed(text_columns(docs).mapInArrow(run, "kind long, a long, b long, c long"))


def ranked(counts: np.ndarray) -> np.ndarray:
    """By step of entropy its rank, 0 for the rarest, from the windows of each step."""
    order = np.lexsort((np.arange(STEPS), counts, np.arange(STEPS) < WEAK))
    rank = np.empty(STEPS, np.int64)
    rank[order] = np.arange(STEPS)
    return rank


def ranks(survey: DataFrame) -> np.ndarray:
    counts = np.zeros(STEPS, np.int64)
    for r in survey.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n")).collect():  # STEPS rows
        counts[r["a"]] = r["n"]
    return ranked(counts)


def limits(survey: DataFrame, n: int) -> list[tuple[int, int]]:
    """The first (doc_id, text hash) of each of at most n ranges of about the same bytes."""
    names = survey.where("kind = 0").groupBy("a", "b").agg(F.max("c").alias("c"))
    total = names.agg(F.sum(F.col("c") + 64).alias("n")).first()["n"] or 0
    placed = with_positions(names, [F.col("a"), F.col("b")], F.col("c") + 64)
    firsts = placed.groupBy(F.expr(f"off * {n} div {max(total, 1)}")).agg(F.min(F.struct("a", "b")).alias("name")).collect()  # a row a range
    return sorted((r["name"]["a"], r["name"]["b"]) for r in firsts)


def digests(data: np.ndarray, off: np.ndarray, rank: np.ndarray) -> list[np.ndarray]:
    """Of each document its filters, as an array of (filters, BITS / 64) words, features in order."""
    out: list[np.ndarray] = []
    poly = Polynomial(data)
    e = entropies(data)
    key = rank[e] << 32 | np.arange(len(e))
    beyond = np.full(SPAN - 1, np.iinfo(np.int64).max)  # SPAN is a power of two
    for a, b in zip(off[:-1], off[1:]):
        n = b - a - WINDOW + 1
        if b == a:
            out.append(np.zeros((0, BITS // 64), np.uint64))
            continue
        if n <= 0:
            h = poly.ranges(np.array([a]), np.array([b]))
        else:
            own = np.concatenate([beyond, key[a : a + n], beyond])
            width = 1
            while width < SPAN:
                own = np.minimum(own[:-width], own[width:])
                width *= 2
            place, wins = np.unique(own & 0xFFFFFFFF, return_counts=True)
            place = place[wins >= POPULAR]
            h = poly.ranges(place, place + WINDOW)
            _, first = np.unique(h, return_index=True)
            h = h[np.sort(first)]
        bits = np.zeros((-(-len(h) // PER_FILTER), BITS), bool)
        which = np.arange(len(h)) // PER_FILTER
        for k in range(5):
            bits[which, (h >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
        out.append(np.packbits(bits, axis=1).view(np.uint64))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    mine, theirs = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for x, n in zip(a, mine):
        both = np.bitwise_count(b & x).sum(1, dtype=np.int64)
        chance, most = n * theirs / BITS, np.minimum(n, theirs)
        total += float(np.max(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), 0.0)))
    return min(1.0, max(0.0, total / len(a)))


def written(d: np.ndarray) -> str:
    return f"{len(d)}:{base64.b64encode(d.tobytes()).decode()}"


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next. The edited text is the document with its last quarter of code points
    replaced by the first as many of the next document. Ranks of another corpus may be given.

    The first document of a range goes to the range before as well, as a guest, so that every last
    document meets its next; the last range's guest is the first document of all."""
    n = buckets(docs)
    survey = surveyed(docs)
    rank = ranks(survey) if rank is None else rank
    cuts = limits(survey, n)
    before = {name: (k - 1) % len(cuts) for k, name in enumerate(cuts)}

    def send(it):
        held, size = [], 0

        def flush():
            ids, null, thash = (np.concatenate([p[k] for p in held]) for k in range(3))
            lengths = np.concatenate([np.diff(p[4]) for p in held])
            data = np.concatenate([p[3] for p in held])
            off = np.concatenate([[0], np.cumsum(lengths)])
            names = list(zip(ids.tolist(), thash.tolist()))
            copies = Counter(names)
            one = list({name: i for i, name in enumerate(names)}.items())  # rows equal in both, once
            to = [(bisect_right(cuts, name) - 1, i, copies[name]) for name, i in one] + [(before[name], i, 0) for name, i in one if name in before]
            to.sort()
            at, row, times = (np.array(x, np.int64) for x in zip(*to))
            for b in np.unique(at):
                own = at == b
                r = row[own]
                yield int(b), 0, freeze({"times": times[own], "ids": ids[r], "null": null[r], "thash": thash[r], "len": lengths[r], "data": np.concatenate([data[off[i] : off[i + 1]] for i in r])}, 3)

        def rows():
            nonlocal held, size
            for part in document_batches(it):
                held.append(part)
                size += len(part[3])
                if size > FLUSH:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        yield from batches(rows())

    def compare(it):
        for _, blobs in blobs_by_bucket(it):
            parts = [thaw(b) for _, b in blobs]
            del blobs
            x = {k: np.concatenate([p[k] for p in parts]) for k in ("times", "ids", "null", "thash", "len")}
            base = np.concatenate([[0], np.cumsum([len(p["len"]) for p in parts])])
            offs = [np.concatenate([[0], np.cumsum(p["len"])]) for p in parts]

            def text(i):
                p = int(np.searchsorted(base, i, "right")) - 1
                o = offs[p]
                k = i - base[p]
                return parts[p]["data"][o[k] : o[k + 1]].tobytes()

            # own documents in order, each with its number of rows, then the guest
            order = np.lexsort((x["thash"], x["ids"], x["times"] == 0))
            same = np.zeros(len(order), bool)
            same[1:] = (x["ids"][order][1:] == x["ids"][order][:-1]) & (x["thash"][order][1:] == x["thash"][order][:-1]) & ((x["times"][order][1:] == 0) == (x["times"][order][:-1] == 0))
            begin = np.flatnonzero(~same)
            own, times = order[begin], np.add.reduceat(x["times"][order], begin)
            last = int((times > 0).sum())

            def emit(lo, hi):
                """Documents lo to hi - 1 of the order, and the one that follows them."""
                raw = [text(i) for i in own[lo : hi + 1]]
                texts = [r.decode() for r in raw]
                again = [k for k in range(hi - lo) if times[lo + k] > 1]  # their own next, but for the last row
                edits = [(k, k + 1) for k in range(hi - lo)] + [(k, k) for k in again]
                edited = []
                for i, j in edits:
                    k = len(texts[i]) // 4
                    edited.append((texts[i][: len(texts[i]) - k] + texts[j][:k]).encode())
                every = raw + edited
                off = np.concatenate([[0], np.cumsum([len(r) for r in every])])
                found = digests(np.frombuffer(b"".join(every), np.uint8), off, rank)
                plain, changed = found[: len(raw)], found[len(raw) :]
                row = np.array([e[0] for e in edits])
                made = pa.RecordBatch.from_arrays(
                    [nullable_ids(x["ids"][own[lo + row]], x["null"][own[lo + row]]), pa.array([len(texts[i]) for i, _ in edits], pa.int64()), pa.array([sha256(e).hexdigest() for e in edited]), pa.array([written(plain[i]) for i, _ in edits]), pa.array([written(d) for d in changed]), pa.array([likeness(plain[i], d) for (i, _), d in zip(edits, changed)], pa.float64()), pa.array([likeness(plain[i], plain[j]) for i, j in edits], pa.float64())],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )
                yield made.slice(0, hi - lo)
                for k, i in enumerate(again):
                    for done in range(0, int(times[lo + i]) - 1, 1000):
                        yield made.take(pa.array([hi - lo + k] * min(1000, int(times[lo + i]) - 1 - done)))

            lo, size = 0, 0
            for k in range(last):
                size += int(x["len"][own[k]])
                if size > (1 << 18) or k == last - 1:
                    yield from emit(lo, k + 1)
                    lo, size = k + 1, 0

    out = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return exchanged(text_columns(docs).mapInArrow(send, EXCHANGE), n).mapInArrow(compare, out)
