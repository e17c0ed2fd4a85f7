"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z; ASCII punctuation
doesn't count. Each character of a script without spaces (UNSPACED) is a word. Two passes over the corpus:

1. how many documents hold each word and each SEED-word n-gram of the benchmark's items;
2. an item's seeds are its n-grams but those far commoner than its others (so an item that leaked into
   a large share of the corpus keeps its seeds); where two of the commoner ones follow one another, both
   together, one word longer, are a seed too, so no part of an item is without seeds. Hits of a
   document on an item, close together, mark a passage; its words are aligned with the item's, a match
   earning the word's IDF weight, or FLOOR of the item's mean weight if that is more (so a part that
   leaked widely still counts beside one that didn't), a mismatch or gap costing GAP of that mean (so
   edits cost the same part of an item that leaked widely). The score is the alignment's over the item's
   with itself, 0 to 1. A passage whose words can't reach the threshold even in the best order is not
   aligned.

An item of fewer than SEED words is found, with score 1, where a line of the document has exactly its
words: in running text such words say nothing.

Nothing of the corpus moves. The items come to the driver and are broadcast in parts of at most about
PART_BYTES of text, two passes for each part.

Defined cases: null and empty texts are clean; items without words match nothing; equal items are each
reported; repeated rows give repeated results; an empty benchmark leaves all clean, an empty table
gives no rows; clean() gives all columns back as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import U, Polynomial, document_batches, lowered, mix, runs, seeds, text_columns, views, words
from siltbed.llm.licences import WORD

SEED, THRESHOLD, GAP, FLOOR = 3, 0.4, 0.5, 0.5
PART_BYTES = 16 << 20
#: Code points, from and to before, of scripts that are written without spaces: Thai, Lao, Tibetan,
#: Myanmar, Khmer, Tai, Chinese, kana, bopomofo, Yi.
UNSPACED = np.array([
    (0x0E00, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x1A20, 0x1AB0), (0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3021, 0x302A), (0x3031, 0x3130), (0x31A0, 0x31C0), (0x31F0, 0x3200),
    (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xA9E0, 0xAA00), (0xAA60, 0xAAE0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x40000),
])


def split(low: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The words with each character of a script without spaces as a word of its own."""
    lead = np.flatnonzero(low >= 0xE0)
    if not len(lead) or not len(start):
        return start, end
    b = low[np.minimum(lead[:, None] + np.arange(4), len(low) - 1)].astype(np.int64) & [0xFF, 63, 63, 63]
    long = b[:, 0] >= 0xF0
    point = np.where(long, (b[:, 0] & 7) << 18 | b[:, 1] << 12 | b[:, 2] << 6 | b[:, 3], (b[:, 0] & 15) << 12 | b[:, 1] << 6 | b[:, 2])
    own = np.searchsorted(UNSPACED.ravel(), point, "right") % 2 == 1
    cut = np.unique(np.concatenate([lead[own], (lead + 3 + long)[own]]))
    k = np.searchsorted(start, cut, "right") - 1
    cut = cut[(k >= 0) & (cut > start[k]) & (cut < end[k])]
    return np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))


def hashed_words(data: np.ndarray, off: np.ndarray):
    """Hashes of all words; the first word of each document, with the total at the end; and by word the
    number of line ends before it."""
    low = lowered(data)
    start, end = split(low, *words(low, off, WORD))
    h = Polynomial(low).ranges(start, end) if len(start) else np.empty(0, U)
    return h, np.searchsorted(start, off), np.searchsorted(np.flatnonzero(data == 10), start)


def grams(h: np.ndarray, first: np.ndarray, n: int = SEED):
    """(hash, place) of the n-grams that lie within one document."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, U), np.empty(0, np.int64)
    weight = seeds(n, 2000)
    with np.errstate(over="ignore"):
        acc = np.zeros(count, U)
        for i in range(n):
            acc += h[i : i + count] * weight[i]
    inside = np.ones(count, bool)
    for k in range(1, n):  # a gram that begins less than n before the end of its document
        at = first[1:] - k
        inside[at[(at >= 0) & (at < count)]] = False
    place = np.flatnonzero(inside)
    return mix(acc[place]), place


def lookup(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places in the sorted `known`, or -1. Most hashes are absent: a table of their low bits says so."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


class Sieve:
    """A sorted set of hashes with a bit table in front."""

    def __init__(self, known: np.ndarray):
        self.known = np.unique(known)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.known & U(0xFFFFF)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in h, index in known) of those that are in the set."""
        maybe = np.flatnonzero(self.bits[(h & U(0xFFFFF)).astype(np.int64)])
        at = lookup(self.known, h[maybe])
        return maybe[at >= 0], at[at >= 0]


class Benchmark:
    """Items as word numbers, with their n-grams."""

    def __init__(self, items: list[tuple[int | None, str]]):
        texts = [(i, (t or "").encode()) for i, t in items]
        data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
        off = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])]).astype(np.int64)
        h, first, _ = hashed_words(data, off)
        self.names = [i for i, _ in texts]
        self.words = Sieve(h)
        number = lookup(self.words.known, h)
        self.items = [number[a:b] for a, b in zip(first[:-1], first[1:])]
        g, place = grams(h, first)
        self.grams = Sieve(g)
        self.item_of = np.searchsorted(first, place, "right") - 1
        self.offset_of = place - first[self.item_of]
        self.gram_of = lookup(self.grams.known, g)
        # items too short for a seed, by the hash of their words
        short = [k for k, x in enumerate(self.items) if 0 < len(x) < SEED]
        self.short = [(n, Sieve(one), one, own) for n in range(1, SEED) if (own := [k for k in short if len(self.items[k]) == n]) for one in [np.concatenate([grams(h[first[k] : first[k + 1]], np.array([0, n]), n)[0] for k in own])]]
        self.words_of, self.first_of = h, first
        self.idf, self.seeds, self.longer = None, None, None

    def empty(self) -> bool:
        return not len(self.grams.known) and not self.short

    def weigh(self, n_docs: int, counts: np.ndarray) -> None:
        """counts: documents by word, then by n-gram."""
        df, gram_df = counts[: len(self.words.known)], counts[len(self.words.known) :]
        top = math.log(n_docs + 2)
        self.idf = np.maximum(0.05, (math.log(n_docs + 2) - np.log(df + 1)) / top)
        rare = np.zeros(len(self.gram_of), bool)
        edge = np.searchsorted(self.item_of, np.arange(len(self.items) + 1))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            n = gram_df[self.gram_of[a:b]]
            rare[a:b] = n <= 4 * np.median(n) + 16 if b > a else False
        self.seeds = self.posted(self.grams.known[self.gram_of], np.flatnonzero(rare))
        # commoner n-grams that follow one another in an item, as one of SEED + 1 words
        common = np.flatnonzero(~rare[:-1] & ~rare[1:] & (self.item_of[:-1] == self.item_of[1:])) if len(rare) else np.empty(0, np.int64)
        longer, place = grams(self.words_of, self.first_of, SEED + 1)
        at = np.searchsorted(place, self.first_of[self.item_of[common]] + self.offset_of[common])
        of_gram = np.zeros(len(self.gram_of), U)
        of_gram[common] = longer[at]
        self.longer = self.posted(of_gram, common)

    @staticmethod
    def posted(hashes: np.ndarray, rows: np.ndarray):
        """A sieve of the hashes of these n-grams, and by hash the n-grams that have it."""
        sieve = Sieve(hashes[rows])
        seed = lookup(sieve.known, hashes[rows])
        sort = np.argsort(seed, kind="stable")
        return sieve, rows[sort], np.searchsorted(seed[sort], np.arange(len(sieve.known) + 1))

    def hits(self, h: np.ndarray, first: np.ndarray):
        """(n-gram of an item, word of a document) of all seeds found."""
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for n, (sieve, posting, edge) in ((SEED, self.seeds), (SEED + 1, self.longer)):
            if len(sieve.known):
                g, place = grams(h, first, n)
                at, seed = sieve.find(g)
                times = edge[seed + 1] - edge[seed]
                which = posting[np.repeat(edge[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                out.append((which, np.repeat(place[at], times)))
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def whole_lines(self, h: np.ndarray, first: np.ndarray, line: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """The short items that are whole lines, each once a document."""
        best: dict[tuple[int, int], tuple] = {}
        doc = np.searchsorted(first, np.arange(len(h)), "right") - 1
        begin = np.ones(len(h), bool)
        begin[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        for n, sieve, own, items in self.short:
            if len(h) < n:
                continue
            end = np.append(begin, True)[n:]  # by place: whether the word after the next n - 1 begins a line
            place = np.flatnonzero(begin[: len(h) - n + 1] & end)
            for k in range(1, n):
                place = place[~begin[place + k]]
            weight, acc = seeds(n, 2000), np.zeros(len(place), U)
            with np.errstate(over="ignore"):
                for k in range(n):
                    acc += h[place + k] * weight[k]
                g = mix(acc)
            for i in sieve.find(g)[0].tolist():
                for item in (k for k, x in zip(items, own.tolist()) if x == int(g[i])):
                    d, at = int(doc[place[i]]), int(place[i])
                    best.setdefault((d, item), (1.0, at - int(first[d]), at - int(first[d]) + n - 1))
        return [(d, k, *v) for (d, k), v in best.items()]

    def weights(self, item: np.ndarray) -> np.ndarray:
        """What a match of each of an item's words earns."""
        own = self.idf[item]
        return np.maximum(own, FLOOR * own.mean())

    def align(self, item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
        """The best local alignment's score, and where it ends in the passage."""
        weight = self.weights(item)
        gap = GAP * float(weight.mean())
        row, best, end = np.zeros(len(passage) + 1), 0.0, 0
        slope = gap * np.arange(len(passage) + 1)
        for w, gain in zip(item.tolist(), weight.tolist()):
            new = np.maximum(row - gap, 0)
            new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == w, gain, -gap))
            row = np.maximum.accumulate(new + slope) - slope
            k = int(row.argmax())
            if row[k] > best:
                best, end = float(row[k]), k
        return best, end

    def matches(self, h: np.ndarray, first: np.ndarray, line: np.ndarray, threshold: float) -> list[tuple[int, int, float, int, int]]:
        """(document, item, score, first word, last word) of the documents' best passages by item."""
        lines = self.whole_lines(h, first, line) if self.short else []
        which, word = self.hits(h, first)
        if not len(which):
            return lines
        doc = np.searchsorted(first, word, "right") - 1
        item, begin = self.item_of[which], word - self.offset_of[which]
        order = np.lexsort((begin, item, doc))
        doc, item, begin = doc[order], item[order], begin[order]
        number = np.full(len(h), -1)
        there, w = self.words.find(h)
        number[there] = w
        length = np.array([len(x) for x in self.items])
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > length[item[1:]])
        edge = np.append(np.flatnonzero(new), len(doc))
        best: dict[tuple[int, int], tuple] = {}
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            d, k = int(doc[a]), int(item[a])
            own = self.items[k]
            pad = len(own) // 3 + 4
            lo, hi = max(int(first[d]), int(begin[a]) - pad), min(int(first[d + 1]), int(begin[b - 1]) + len(own) + pad)
            passage, weight = number[lo:hi], self.weights(own)
            whole = weight.sum()
            if weight[np.isin(own, passage)].sum() < threshold * whole:
                continue
            score, end = self.align(own, passage)
            if score >= threshold * whole and score / whole > best.get((d, k), (0.0,))[0]:
                _, back = self.align(own[::-1], passage[:end][::-1])
                best[d, k] = (score / whole, lo + end - back - int(first[d]), lo + end - 1 - int(first[d]))
        return lines + [(d, k, *v) for (d, k), v in best.items()]


def parts_of(benchmark: DataFrame) -> list[Benchmark]:
    """The items, in parts of about PART_BYTES; each is collected by itself."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // PART_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    return [Benchmark(sorted(((r["item_id"], r["text"]) for r in rows.where(part == k).collect()), key=lambda x: (x[0] is not None, x[0], x[1]))) for k in range(n)]


def weighed(docs: DataFrame, benchmark: DataFrame) -> list[Benchmark]:
    found = []
    for bench in parts_of(benchmark):
        if bench.empty():
            continue

        def count(it, bench=bench):
            n_words = len(bench.words.known)
            total, n_docs = np.zeros(n_words + len(bench.grams.known), np.int64), 0
            for _, _, _, data, off in document_batches(it):
                n_docs += len(off) - 1
                for lo, hi in runs(off):
                    h, first, _ = hashed_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    g, place = grams(h, first)
                    for sieve, x, where, base in ((bench.words, h, None, 0), (bench.grams, g, place, n_words)):
                        at, k = sieve.find(x)
                        doc = np.searchsorted(first, at if where is None else where[at], "right") - 1
                        pair = np.unique(doc * len(sieve.known) + k)
                        total[base : base + len(sieve.known)] += np.bincount(pair % len(sieve.known), minlength=len(sieve.known))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(total[some], n_docs), pa.int64())], ["k", "n"])

        counts = np.zeros(len(bench.words.known) + len(bench.grams.known), np.int64)
        n_docs = 0
        for r in text_columns(docs).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # as many as the part has words and n-grams
            if r["k"] < 0:
                n_docs = r["n"]
            else:
                counts[r["k"]] = r["n"]
        bench.weigh(n_docs, counts)
        found.append(bench)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the documents that hold an item, exact or
    edited, with the best passage's place in words from 0."""
    schema = "doc_id long, item_id long, score double, first_word long, last_word long"
    spark, every = docs.sparkSession, []
    for bench in weighed(docs, benchmark):
        shared = spark.sparkContext.broadcast(bench)

        def run(it, shared=shared):
            bench = shared.value
            for ids, null, _, data, off in document_batches(it):
                rows = []
                for lo, hi in runs(off):
                    h, first, line = hashed_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    rows += [(None if null[lo + d] else int(ids[lo + d]), bench.names[k], s, a, b) for d, k, s, a, b in bench.matches(h, first, line, threshold)]
                if rows:
                    c = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.float64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], ["doc_id", "item_id", "score", "first_word", "last_word"])

        every.append(text_columns(docs).mapInArrow(run, schema))
    if not every:
        return spark.createDataFrame([], schema)
    out = every[0]
    for more in every[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    out = docs
    for bench in weighed(docs, benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(bench)

        def run(it, shared=shared):
            for batch in it:
                text = batch.column(batch.schema.get_field_index("text")).cast(pa.string()).fill_null("")
                data, off = views(text)
                keep = np.ones(batch.num_rows, bool)
                for lo, hi in runs(off) if batch.num_rows else ():
                    h, first, line = hashed_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                    keep[[lo + m[0] for m in shared.value.matches(h, first, line, threshold)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
