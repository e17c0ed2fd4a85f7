"""N-gram Jaccard join with token-combination prefixes.

A document's set holds its distinct n-word shingles. Two sets link when 100 * |intersection| >= percent *
|union|. Rows with equal sets are one class; the join works on classes.

Order of the shingles: rare ones before frequent ones (in at least max(32, documents / 5000)
documents), by hash within. A set of s shingles can miss at most m = s - ceil(percent * s / 100) of
them in a partner.

* With more than m rare shingles, the prefix is the first m + EXTEND rare ones (fewer if it has fewer),
  each indexed by itself. Of a prefix of p, partners share at least p - m.
* Otherwise the prefix goes on into the frequent ones, dealt by hash into sub-classes, until the rare
  ones and, from each sub-class of c, c - 1 come to m + 1; indexed are the rare ones by themselves and
  all pairs of a sub-class. m missing shingles cannot break them all. The number of sub-classes
  follows the size level (powers of 100 / percent), and a set is indexed at its own level and the
  next, so that partners have one in common.

Signatures that one set alone has go, and so do sets that share fewer than any partner would have to.
What is left are rows (signature, set): groups of any size, never listed in one place.

Union first, then only what is not tied yet:

1. Rounds. Of each group two sets are pivots, drawn by hash; in the first round one is the set with the
   smallest part of rare shingles. A set meets the pivot that it shares most
   signatures with, if those are as many as partners must share: at most two pairs a set and round.
   Pairs are verified on the whole sets, links give components. In a cluster of near copies, however
   large, most sets are then tied, and a group whose sets are all in one component is done. Rounds go on
   while they at least halve the pairs that are left and those are many more than the rows.
2. The rest: sets of one group but different components, with sizes that can link. In groups of more
   than LARGE sets only those sets are paired that have as many large groups as partners must share
   signatures; two others that link have a smaller group in common. Every set has a
   sketch, the parities of its shingles' numbers in BITS classes: sets differ in at least as many shingles
   as their sketches in bits, so pairs whose sketches differ too much for a link go within the join. Those
   that share too few signatures, or were verified before, go too; the others are verified.

So no pair of sets that could link is left out unless both are in one component already. Every pair is
a row of a join; work() counts them. With counts=True no round is made and every candidate is
verified, which costs the square of a cluster's distinct sets, because the number of links needs each.

The frequent shingles are broadcast: at most (sum of set sizes) / limit <= 5000 x the mean set size,
however many documents there are.

Defined cases: documents without words (or text) have no set and link with nothing; one with fewer
than n words has its whole sequence as its one shingle; repeated rows link as equal sets; rows with
null ids are given back with a null component, link with nothing and lead to nothing; an empty table
gives no rows; other columns are not read, or given back as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import CHUNK, EXCHANGE, FLUSH, U, batches, blobs_by_bucket, bucket_of, buckets, checkpointed, components, distinct, document_batches, exchanged, freeze, joined, mix, nullable_ids, pack, released, runs, settled, shingles, text_columns, text_hash, thaw

EXTEND = 16
#: Sets of a signature that a task sends to the signature's own bucket.
HEAD = 64
#: Sets of a group from which on only those are paired that have many such groups.
LARGE = 64
#: Pairs left for a row of signatures that need no further round.
FAIR = 4
#: Bits of a set's sketch, and the columns that hold them.
BITS = 512
WORDS = [f"w{k}" for k in range(BITS // 64)]
#: Pairs of one set that are verified together.
SPLIT = 256
#: Bits of the map of wanted sets for each of them, and at most; what it can't tell is sent in vain.
ROOM, MAP = 16, 1 << 25
#: Bytes of shingles or signatures that a task gathers, and counts or thins out together.
GATHER = 48 << 20


def sets_of(data, off, n):
    """(shingles, edges, fingerprints): the sorted distinct shingles of all documents, where each
    document's begin and end, and a hash of each set."""
    h, owner = distinct(*shingles(data, off, n))
    edges = np.searchsorted(owner, np.arange(len(off)))
    with np.errstate(over="ignore"):
        total = np.concatenate([[U(0)], np.cumsum(mix(h ^ U(0x51ED270B)), dtype=U)])
        sizes = np.diff(edges)
        fp = mix(total[edges[1:]] - total[edges[:-1]] + sizes.astype(U))
    return h, edges, fp


def chunks_of_sets(it, n):
    for ids, null, thash, data, off in document_batches(it):
        for lo, hi in runs(off):
            h, edges, fp = sets_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
            yield (ids[lo:hi], null[lo:hi], thash[lo:hi], h, edges, fp, data, off[lo : hi + 1])


def members(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, thash, n_shingles, fp) by row."""

    def run(it):
        for ids, null, thash, _, edges, fp, _, _ in chunks_of_sets(it, n):
            yield pa.RecordBatch.from_arrays([nullable_ids(ids, null), pa.array(thash), pa.array(np.diff(edges), pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "thash", "n_shingles", "fp"])

    return text_columns(docs).mapInArrow(run, "doc_id long, thash long, n_shingles long, fp long")


def frequent(docs: DataFrame, n: int, least: int, parts: int) -> np.ndarray:
    """Shingles of at least `least` documents, counted over all tasks that hold one more than once."""

    def count(it):
        waiting, size = [], 0

        def rows():
            token, times = np.unique(np.concatenate(waiting), return_counts=True)
            token, times = token[times > 1], times[times > 1]
            for b, blob in pack({"t": token, "n": times.astype(np.uint32)}, bucket_of(token, parts), parts):
                yield b, 0, blob

        for _, _, _, h, *_ in chunks_of_sets(it, n):
            waiting.append(h)
            size += h.nbytes
            if size > GATHER:
                yield from batches(rows())
                waiting, size = [], 0
        if waiting:
            yield from batches(rows())

    def add(it):
        for _, blobs in blobs_by_bucket(it):
            x = joined([b for _, b in blobs], ["t", "n"], [U, np.uint32])
            token, at = np.unique(x["t"], return_inverse=True)
            total = np.bincount(at, x["n"])
            yield pa.RecordBatch.from_arrays([pa.array(token[total >= least].view(np.int64))], ["t"])

    rows = exchanged(text_columns(docs).mapInArrow(count, EXCHANGE), parts).mapInArrow(add, "t long").collect()  # bounded: see above
    return np.sort(np.array([r["t"] for r in rows], np.int64).view(U))


class Signer:
    def __init__(self, often: np.ndarray, percent: int):
        self.often, self.percent = often, percent

    def missing(self, s):
        return s - -(-self.percent * s // 100)

    def level(self, s: int) -> int:
        return int(np.log(s) / np.log(100 / self.percent) + 1e-9) if self.percent < 100 else 0  # of 100, only equal sets link

    def classes(self, level: int) -> int:
        return max(1, int(0.04 * (100 / self.percent) ** level))  # small sets have no shingles to spare for more

    def sign(self, h, edges, doc_of_set):
        """(signature, document, shared, rare): signatures of the sets doc_of_set, how many of a
        document's signatures a partner must share at least, and how many rare shingles it has."""
        sizes = np.diff(edges)[doc_of_set]
        at = np.minimum(np.searchsorted(self.often, h), max(0, len(self.often) - 1))
        common = self.often[at] == h if len(self.often) else np.zeros(len(h), bool)
        sig, doc, need, rares = [], [], [], []
        for d, s in zip(doc_of_set.tolist(), sizes.tolist()):
            m = self.missing(s)  # of 0, a partner holds the whole set and more
            own, often = h[edges[d] : edges[d + 1]], common[edges[d] : edges[d + 1]]
            rare = own if not often.any() else own[~often]
            count = len(rare)
            if count > m:
                rare = rare[: m + EXTEND]
                sig.append(rare)
                doc.append(np.full(len(rare), d))
                need.append(np.full(len(rare), len(rare) - m))
                rares.append(np.full(len(rare), count))
                continue
            found = [rare, *(self.pairs(own[often], m + 1 - len(rare), level) for level in (self.level(s), self.level(s) + 1))]
            found = np.unique(np.concatenate(found))
            sig.append(found)
            doc.append(np.full(len(found), d))
            need.append(np.ones(len(found), np.int64))
            rares.append(np.full(len(found), count))
        if not sig:
            return np.empty(0, U), *(np.empty(0, np.int64) for _ in range(3))
        return np.concatenate(sig), np.concatenate(doc), np.concatenate(need), np.concatenate(rares)

    def pairs(self, often: np.ndarray, need: int, level: int) -> np.ndarray:
        g = self.classes(level)
        sub = (often % U(g)).astype(np.int64)
        order = np.argsort(sub, kind="stable")
        rank = np.empty(len(often), np.int64)
        sizes = np.bincount(sub, minlength=g)
        rank[order] = np.arange(len(often)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # how many of its sub-class came before
        gained = np.cumsum(rank > 0)
        end = int(np.searchsorted(gained, need)) + 1  # all of them, if they do not come to it: no partner is then possible but by rare ones
        t, sub = often[:end], sub[:end]
        order = np.argsort(sub, kind="stable")
        t, sub = t[order], sub[order]
        out = []
        with np.errstate(over="ignore"):
            for lag in range(1, len(t)):
                same = sub[lag:] == sub[:-lag]
                if not same.any():
                    break
                out.append(mix(t[:-lag][same] * U(0x9E3779B97F4A7C15) + t[lag:][same] * U(0xC2B2AE3D27D4EB4F) + U(level)))
        return np.concatenate(out) if out else np.empty(0, U)


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(fp, sig, size, need, rare): the signatures that several sets have, of the sets that share as many as a
    partner must have in common with them."""
    parts = buckets(docs)
    signer = Signer(frequent(docs, n, max(32, docs.count() // 5000), parts), percent)
    shared = docs.sparkSession.sparkContext.broadcast(signer.often)

    def index(it):
        own = Signer(shared.value, percent)
        held, size = [], 0

        def rows():
            sig, fp, count, need, rare = (np.concatenate([x[k] for x in held]) for k in range(5))
            # each set once: copies in this task have the same signatures
            order = np.lexsort((fp, sig))
            sig, fp, count, need, rare = sig[order], fp[order], count[order], need[order], rare[order]
            new, first = np.ones(len(sig), bool), np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            first[1:] = new[1:] | (fp[1:] != fp[:-1])
            sig, fp, count, need, rare, new = sig[first], fp[first], count[first], need[first], rare[first], new[first]
            # of a group's sets in this task HEAD go to the signature's bucket, which so never holds a
            # large group; the others, surely shared, to buckets of their own
            at = np.arange(len(sig))
            more = at - np.maximum.accumulate(np.where(new, at, 0)) >= HEAD
            for kind, rest in ((0, ~more), (1, more)):
                by = bucket_of(mix(sig[rest] if kind == 0 else fp[rest]), parts)
                for b, blob in pack({"sig": sig[rest], "fp": fp[rest], "n": count[rest], "need": need[rest], "rare": rare[rest]}, by, parts):
                    yield b, kind, blob

        known = set()
        for _, _, _, h, edges, fp, _, _ in chunks_of_sets(it, n):
            fresh = np.array([i for i, x in enumerate(fp.tolist()) if x not in known and not known.add(x)], np.int64)
            if len(known) > 2_000_000:
                known.clear()
            if not len(fresh):
                continue
            fresh = fresh[np.diff(edges)[fresh] > 0]
            sig, doc, need, rare = own.sign(h, edges, fresh)
            if len(sig):
                held.append((sig, fp[doc], np.diff(edges)[doc].astype(np.uint32), need.astype(np.uint16), rare.astype(np.uint32)))
                size += len(sig) * 26
            if size > GATHER:
                yield from batches(rows())
                held, size = [], 0
        if held:
            yield from batches(rows())

    def thin(it):
        """The rows of signatures that several sets have, with the least need of their sets."""
        for _, blobs in blobs_by_bucket(it):
            for kind in (0, 1):
                x = joined([b for k, b in blobs if k == kind], ["sig", "fp", "n", "need", "rare"], [U, U, np.uint32, np.uint16, np.uint32])
                if not len(x["sig"]):
                    continue
                sig, fp, size, need, rare = x["sig"], x["fp"], x["n"], x["need"].astype(np.int32), x["rare"].astype(np.int32)
                least = np.ones(len(sig), np.int32)
                if kind == 0:
                    order = np.lexsort((fp, sig))
                    sig, fp, size, need, rare = sig[order], fp[order], size[order], need[order], rare[order]
                    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
                    several = np.minimum.reduceat(fp, begin) != np.maximum.reduceat(fp, begin)
                    width = np.diff(np.append(begin, len(sig)))
                    least, keep = np.repeat(np.minimum.reduceat(need, begin), width), np.repeat(several, width)
                    sig, fp, size, need, rare, least = sig[keep], fp[keep], size[keep], need[keep], rare[keep], least[keep]
                for lo in range(0, len(sig), 100_000):
                    cut = slice(lo, lo + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(sig[cut].view(np.int64)), pa.array(fp[cut].view(np.int64)), pa.array(size[cut].astype(np.int32)), pa.array(need[cut]), pa.array(rare[cut]), pa.array(least[cut])], ["sig", "fp", "size", "need", "rare", "least"])

    rows = exchanged(text_columns(docs).mapInArrow(index, EXCHANGE), parts).mapInArrow(thin, "sig long, fp long, size int, need int, rare int, least int")
    rows = rows.repartition(parts, "fp").dropDuplicates(["fp", "sig"])
    # partners share as many signatures as the smaller of their needs; a set's own are no more than its shingles or pairs of them
    own = Window.partitionBy("fp")
    able = rows.select("*", F.count(F.lit(1)).over(own).alias("k"), F.least(F.min("need").over(own), F.min("least").over(own)).alias("enough")).where("k >= enough")
    # dealt and sorted by set for good: labels join it where it is
    return settled(able.select("fp", "sig", "size", "need", "rare"))


def sketches(h: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """By set, BITS bits as 64-bit words: of how many of its shingles each is the number, even or odd.
    Two sets differ in at least as many shingles as their sketches in bits."""
    out = []
    for lo in range(0, len(edges) - 1, 1024):
        e = edges[lo : lo + 1025]
        owner = np.repeat(np.arange(len(e) - 1), np.diff(e))
        bit = (h[e[0] : e[-1]] >> U(20) & U(BITS - 1)).astype(np.int64)
        odd = np.bincount(owner * BITS + bit, minlength=(len(e) - 1) * BITS).reshape(-1, BITS) & 1
        out.append(np.packbits(odd.astype(np.uint8), axis=1).view(np.int64))
    return np.concatenate(out) if out else np.empty((0, len(WORDS)), np.int64)


def map_of(wanted: DataFrame) -> np.ndarray:
    """A bit map in which every wanted set's bit is set, in 64-bit words: ROOM bits a set, MAP bits at most
    whatever their number. Other sets have their bit set by chance only: one in ROOM, or more of them where
    MAP is too small, up to all."""
    bits = min(MAP, 1 << max(10, (ROOM * wanted.count()).bit_length()))
    word = F.shiftright(F.col("fp").bitwiseAND(F.lit(bits - 1)), 6).cast("int").alias("word")
    found = wanted.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, int(fp & 63))")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(U)


def mapped(field: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether the sets' bits are set."""
    return field[(fp & U(len(field) * 64 - 1)) >> U(6)] >> (fp & U(63)) & U(1) == 1


def texts_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(fp, text, WORDS): one compressed text of each wanted set, with its sketch, dealt by fp."""
    parts = buckets(docs)
    field = docs.sparkSession.sparkContext.broadcast(map_of(wanted))  # MAP bits at most

    def ask(it):
        def rows():
            for batch in it:
                fp = batch.column("fp").to_numpy().view(U)
                yield from ((b, 0, blob) for b, blob in pack({"fp": fp}, bucket_of(fp, parts), parts))

        yield from batches(rows())

    def send(it):
        held, size, known = [], 0, set()

        def rows():
            fp = np.array([x[0] for x in held], U)
            by = bucket_of(fp, parts)
            for b in np.unique(by):
                own = np.flatnonzero(by == b)
                yield int(b), 1, freeze({"fp": fp[own], "len": np.array([len(held[i][1]) for i in own], np.int64), "data": np.frombuffer(b"".join(held[i][1] for i in own), np.uint8), "bits": np.concatenate([held[i][2] for i in own])}, 3)

        for _, _, _, h, edges, fp, data, off in chunks_of_sets(it, n):
            some = np.flatnonzero((np.diff(edges) > 0) & mapped(field.value, fp))
            some = [i for i in some if (name := int(fp[i])) not in known and not known.add(name)]
            if not some:
                continue
            bits = sketches(np.concatenate([h[edges[i] : edges[i + 1]] for i in some]), np.concatenate([[0], np.cumsum(np.diff(edges)[some])]))
            for i, own in zip(some, bits):
                held.append((int(fp[i]), data[off[i] : off[i + 1]].tobytes(), own.copy()))
                size += off[i + 1] - off[i] + BITS // 8
            if size > FLUSH:
                yield from batches(rows())
                held, size, known = [], 0, set()
        if held:
            yield from batches(rows())

    def pick(it):
        for _, blobs in blobs_by_bucket(it):
            asked = set(joined([b for kind, b in blobs if kind == 0], ["fp"], [U])["fp"].tolist())
            for kind, blob in blobs:
                if kind != 1 or not asked:
                    continue
                x = thaw(blob)
                off = np.concatenate([[0], np.cumsum(x["len"])])
                own = [i for i, name in enumerate(x["fp"].tolist()) if name in asked and not asked.discard(name)]
                if own:
                    pressed = [zstandard.compress(x["data"][off[i] : off[i + 1]].tobytes(), 1) for i in own]
                    bits = x["bits"].reshape(-1, len(WORDS))[own]
                    yield pa.RecordBatch.from_arrays([pa.array(x["fp"][own].view(np.int64)), pa.array(pressed, pa.binary()), *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], ["fp", "text", *WORDS])

    met = wanted.mapInArrow(ask, EXCHANGE).unionByName(text_columns(docs).mapInArrow(send, EXCHANGE))
    found = exchanged(met, parts).mapInArrow(pick, "fp long, text binary, " + ", ".join(f"{w} long" for w in WORDS))
    # dealt and sorted by set for good: joins on fp move the pairs, not the texts
    return settled(found.repartition(parts, "fp").sortWithinPartitions("fp"))


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, link) of pairs (a, b) of sets, by their whole sets. A set b of many pairs is split by a."""
    # few sets have so many pairs; of the others only the texts of a move
    often = checkpointed(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts")).where("parts > 1"))
    text_a, text_b = (texts.select(F.col("fp").alias(name), F.col("text").alias(f"t{name}")) for name in ("a", "b"))
    met = pairs.join(often, "b", "left_anti").join(text_a, "a").join(text_b, "b").select("a", "b", "ta", "tb")
    if not often.isEmpty():
        left = pairs.join(often, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part")).join(text_a, "a")
        right = often.join(text_b, "b").select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        met = met.unionByName(left.join(right, ["b", "part"]).select("a", "b", "ta", "tb"))

    def compare(it):
        for batch in it:
            # a batch's sets, each once, a few at a time
            a, b = batch.column("a").to_numpy().view(U), batch.column("b").to_numpy().view(U)
            order = np.argsort(b, kind="stable")
            texts_a, texts_b = batch.column("ta"), batch.column("tb")
            link, lo = np.zeros(len(a), bool), 0
            while lo < len(order):
                raw, place, size, hi = [], {}, 0, lo
                while hi < len(order) and (hi == lo or size < CHUNK):
                    i = int(order[hi])
                    for name, column in ((int(a[i]), texts_a), (int(b[i]), texts_b)):
                        if name not in place:
                            place[name] = len(raw)
                            raw.append(zstandard.decompress(column[i].as_py()))
                            size += len(raw[-1])
                    hi += 1
                own = order[lo:hi]
                off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
                h, edges, _ = sets_of(np.frombuffer(b"".join(raw), np.uint8), off, n)
                x, y = (np.array([place[int(k)] for k in side[own]]) for side in (a, b))
                sizes = np.diff(edges)
                both = shared_counts(h, edges, x, y)
                link[own] = 100 * both >= percent * (sizes[x] + sizes[y] - both)
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link)], ["a", "b", "link"])

    return met.mapInArrow(compare, "a long, b long, link boolean")


def shared_counts(h: np.ndarray, edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many elements the sorted sets x[i] and y[i] have in common, for all i."""
    sizes = np.diff(edges)
    out = np.zeros(len(x), np.int64)
    for lo in range(0, len(x), 512):
        cut = slice(lo, lo + 512)
        element, pair = [], []
        for side in (x[cut], y[cut]):
            n = sizes[side]
            start = np.repeat(edges[side] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            element.append(h[start + np.arange(n.sum())])
            pair.append(np.repeat(np.arange(len(side)), n))
        element, pair = np.concatenate(element), np.concatenate(pair)
        order = np.lexsort((element, pair))
        element, pair = element[order], pair[order]
        again = (element[1:] == element[:-1]) & (pair[1:] == pair[:-1])
        out[cut] = np.bincount(pair[1:][again], minlength=len(x[cut]))
    return out


def fits(a: str, b: str, percent: int):
    """Whether sets of these sizes can link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def spread(labelled: DataFrame) -> DataFrame:
    """(sig, n, pairs) of the groups that are not in one component: how many sets they have, and how many
    pairs of them are not tied."""
    by_component = labelled.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("n"))
    every = by_component.groupBy("sig").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("tied"))
    return every.where("kinds > 1").select("sig", "n", ((F.col("n") * F.col("n") - F.col("tied")) / 2).alias("pairs"))


def pivots(labelled: DataFrame, turn: int) -> DataFrame:
    """(sig, pivots): of each group two sets, drawn by hash. In the first round one is the set with the
    smallest part of rare shingles: in a cluster of edited copies it's nearest to the others."""
    draw = F.hash("fp", F.lit(turn))
    first = turn == 0
    orders = [(F.col("rare") / F.col("size")).cast("float") if first else draw, draw]
    drawn = [F.lit(True) if first else F.pmod(draw, F.lit(2)) == 0, F.pmod(draw, F.lit(2)) == 1]
    rest = ["fp", "size", "need"] + ["c"] * (not first)  # at first every set is its own component
    found = labelled.groupBy("sig").agg(*[F.min(F.when(d, F.struct(o.alias("draw"), *rest))).alias(f"p{k}") for k, (o, d) in enumerate(zip(orders, drawn))])
    met = [F.when(F.col(p).isNotNull(), F.struct(*[F.col(f"{p}.{c}").alias(c) for c in ("fp", "size", "need")], F.col(f"{p}.{'fp' if first else 'c'}").alias("c"), F.lit(k).alias("kind"))) for k, p in enumerate(("p0", "p1"))]
    return found.select("sig", F.array(*met).alias("pivots"))


def met_pivots(rows: DataFrame, met: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(a, b): every set with at most one pivot of each of the two kinds, not of its own component, if
    their sketches let them link."""
    joined_ = rows.join(met, "sig").select("fp", "size", "need", "c", F.explode("pivots").alias("p"))
    near = joined_.where(F.col("p").isNotNull() & (F.col("p.c") != F.col("c")) & fits("size", "p.size", percent))
    counted = near.groupBy("fp", F.col("p.fp").alias("b")).agg(F.count(F.lit(1)).alias("k"), F.first(F.least("need", "p.need")).alias("need"), F.first("p.kind").alias("kind"), F.first("size").alias("size_x"), F.first("p.size").alias("size_y")).where("k >= need")
    best = counted.groupBy("fp", "kind").agg(F.max(F.struct("k", "b", "size_x", "size_y")).alias("best")).select(F.col("fp").alias("a"), "best.b", "best.size_x", "best.size_y")
    return sketched(best, sketch, percent).distinct()


def alike(percent: int):
    """Whether sets x and y can link by their sketches: linked, they differ in at most (100 - percent) /
    (100 + percent) of both sizes together."""
    apart = sum((F.bit_count(F.col(f"{w}_x").bitwiseXOR(F.col(f"{w}_y"))) for w in WORDS), F.lit(0))
    return apart * (100 + percent) <= (F.col("size_x") + F.col("size_y")) * (100 - percent)


def sketched(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sets of size_x and size_y whose sketches let them link."""
    for name, side in (("a", "x"), ("b", "y")):
        pairs = pairs.join(sketch.select(F.col("fp").alias(name), *[F.col(w).alias(f"{w}_{side}") for w in WORDS]), name)
    return pairs.where(alike(percent)).select("a", "b")


def untied(rows: DataFrame, groups: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of sets of one group and different components that share enough signatures
    and whose sketches let them link."""
    rows = rows.join(groups.select("sig", (F.col("n") > LARGE).alias("large")), "sig").select("fp", "sig", "size", "need", "c", "large")
    rows = checkpointed(rows.withColumn("b", F.sum(F.col("large").cast("int")).over(Window.partitionBy("fp"))).withColumn("spare", F.col("b") < F.col("need")))

    def paired(left: DataFrame, other: DataFrame, condition, more: list[str]) -> DataFrame:
        x, y = (side.select("sig", *[F.col(c).alias(f"{c}_{name}") for c in ("fp", "size", "need", "c", "b", "spare", *more)]) for name, side in (("x", left), ("y", other)))
        both = x.join(y, "sig").where("c_x <> c_y").where(fits("size_x", "size_y", percent)).where(condition)
        least = F.least("need_x", "need_y") - F.when(F.col("spare_x") & F.col("spare_y"), F.least("b_x", "b_y")).otherwise(0)
        lower = F.col("fp_x") < F.col("fp_y")
        sizes = [F.when(lower, F.col(p)).otherwise(F.col(q)).alias(p) for p, q in (("size_x", "size_y"), ("size_y", "size_x"))]
        return both.select(F.least("fp_x", "fp_y").alias("a"), F.greatest("fp_x", "fp_y").alias("b"), least.alias("least"), *sizes)

    # rows of large groups carry sketches, of the others only the pairs that have enough groups
    large = rows.where("large").join(sketch, "fp")
    small = rows.where("not large")
    every = paired(small, small, F.expr("fp_x < fp_y"), []).unionByName(paired(large.where("not spare"), large, F.expr("spare_y or fp_x < fp_y") & alike(percent), WORDS))
    enough = every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), *[F.first(c).alias(c) for c in ("least", "size_x", "size_y")]).where("k >= least").drop("k", "least")
    return sketched(enough, sketch, percent)


def links(docs: DataFrame, n: int, percent: int, counts: bool = False) -> tuple[DataFrame, dict]:
    """(u, v): links between different sets whose components are those of all links; with counts, all
    links. And what was done: rounds, rows (signatures of sets), pairs verified by round, pairs verified
    in the rest, and links."""
    rows = signatures(docs, n, percent)
    done = {"rows": rows.count(), "rounds": [], "rest": 0, "links": 0}
    spark = docs.sparkSession
    released(spark)
    nothing = spark.createDataFrame([], "u long, v long")
    if not done["rows"]:
        return nothing, done
    texts = texts_of(docs, rows.select("fp").distinct(), n)
    sketch = settled(texts.select("fp", *WORDS))
    released(spark)
    tried = None  # all verified pairs
    labelled, before = rows.withColumn("c", F.col("fp")), None
    while True:
        turn = len(done["rounds"])
        groups = checkpointed(spread(labelled))
        left = groups.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("rows")).first()
        if counts or not left["rows"] or (before is not None and (left["pairs"] <= FAIR * left["rows"] or left["pairs"] > before / 2)):
            break
        before = left["pairs"]
        # at first no group is in one component
        some = labelled.join(groups.select("sig"), "sig", "left_semi") if turn else labelled
        met = checkpointed(met_pivots(some, pivots(some, turn), sketch, percent))
        released(spark)
        found = checkpointed(verified(met, texts, n, percent))
        released(spark)
        done["rounds"].append(found.count())
        if not done["rounds"][-1]:
            break
        tried = found if tried is None else tried.unionByName(found)
        tied = components(tried.where("link").select(F.col("a").alias("u"), F.col("b").alias("v")))
        # rows stay where they are: only the labels move
        labelled = rows.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "sig", "size", "need", "rare", F.coalesce("component", "fp").alias("c"))
        released(spark)
    rest = untied(labelled, groups, sketch, percent)
    if tried is not None:
        rest = rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = checkpointed(rest)
    released(spark)
    done["rest"] = rest.count()
    if done["rest"]:
        found = checkpointed(verified(rest, texts, n, percent))
        tried = found if tried is None else tried.unionByName(found)
    if tried is None:
        return nothing, done
    every = tried.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    done["links"] = every.count()
    return every, done


def work(docs: DataFrame, n: int, percent: int, counts: bool = False) -> dict:
    """What the join of docs does: see links()."""
    return links(docs.select("doc_id", "text").where("doc_id is not null"), n, percent, counts)[1]


def grouped(docs: DataFrame, n: int, percent: int, counts: bool = False) -> DataFrame:
    """doc_id, thash, n_shingles, class (doc_id of the first row with an equal set) and first (doc_id
    and thash of the group's first row) of every row, and with counts n_links. Class, first and n_links
    are null for rows without an id or words."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    docs = docs.select("doc_id", "text")
    rows = checkpointed(members(docs, n))  # numbers only; several steps read them
    sets = rows.where("doc_id is not null and n_shingles > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "thash")).alias("head"), F.count(F.lit(1)).alias("copies"))
    linked, _ = links(docs.where("doc_id is not null"), n, percent, counts)
    found = components(linked).select(F.col("node").alias("fp"), "component")
    classed = sets.join(found, "fp", "left").select("fp", "head", "copies", F.coalesce("component", "fp").alias("class"))
    heads = classed.groupBy("class").agg(F.min("head").alias("first"))
    # the groups meet sets, not rows: copies are then one row here
    told = classed.join(heads, "class").select("fp", "head", "first", "copies")
    if counts:
        both = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
        sums = both.join(sets.select(F.col("fp").alias("v"), "copies"), "v").groupBy(F.col("u").alias("fp")).agg(F.sum("copies").alias("partners"))
        told = told.join(sums, "fp", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("partners", F.lit(0)))
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    more = [F.when(own, F.col("n_links")).alias("n_links")] if counts else []
    return rows.join(told.drop("copies"), "fp", "left").select("doc_id", "thash", "n_shingles", F.when(own, F.col("head.doc_id")).alias("class"), F.when(own, F.col("first")).alias("first"), *more)


def join(docs: DataFrame, n: int = 5, percent: int = 80, counts: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) and, with counts,
    n_links (how many other rows it links with, copies included), else class_id (the smallest doc_id
    with an equal set), of every row."""
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first.doc_id", "doc_id"))
    last = F.coalesce("n_links", F.lit(0)).alias("n_links") if counts else F.coalesce("class", "doc_id").alias("class_id")
    return grouped(docs, n, percent, counts).select("doc_id", "n_shingles", component.alias("component_id"), last)


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that are the first of their group by doc_id and hash of the text;
    rows equal in both are one, rows without an id stay."""
    first = F.col("first").isNull() | ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.thash") == F.col("thash")))
    keep = grouped(docs, n, percent).where("doc_id is not null").where(first).select(F.col("doc_id").alias("_keep"), F.col("thash").alias("_keep_hash")).distinct()
    mark = "_" * (1 + max(map(len, docs.columns)))  # no column of docs has this name
    named = docs.where("doc_id is not null").withColumn(mark, text_hash(docs["text"]))
    named = named.join(keep, (named["doc_id"] == keep["_keep"]) & (named[mark] == keep["_keep_hash"]), "left_semi")
    return named.dropDuplicates(["doc_id", mark]).drop(mark).unionByName(docs.where("doc_id is null"))
