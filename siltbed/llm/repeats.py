"""Removal of repeated passages with common-prefix interval trees over enhanced suffix arrays.

Every byte goes that a `length`-byte string covers which also starts earlier (smaller document, or the
same document and an earlier start). Strings never cross documents.

Cutting the corpus into suffix arrays: each string of `length` bytes has an anchor, its GRAM-byte
substring of the smallest hash (leftmost first), so equal strings have equal anchors at equal
offsets. The successive strings of one anchor make a fragment; all that can be equal meets under the
anchor's hash. Two suffixes of one fragment never share `length` bytes, as their anchors would stand
apart.

Fragments that are equal (64-bit hash of the bytes, and equal anchors) have equal suffixes: in the
suffix array each is one entry with all its copies, a leaf of the interval tree whose common prefix
is the whole fragment. Inner nodes come from the sorted suffixes of differing fragments of an anchor and
the lengths of their common prefixes, by a stack scan; only suffixes that agree in their first
`length` bytes are sorted together, which cuts the tree at that depth. Leaves and inner nodes that
can't be extended to the left alike are the maximal repeats: all occurrences but the first are
removed. maximal_repeats() is the only source of removals.

1. Tasks find fragments. The copies within a task are settled there, so a passage that a third of all
   documents share comes to its anchor's bucket once a task, not once a document.
2. By anchor: fragments with their copies. The bytes of one copy of each are asked for where an anchor
   has differing fragments. Anchors with more than HOT of these ask for single strings instead, which
   go to buckets by their own first `length` bytes.
3. By document: the bytes.
4. By anchor or string: the tree. 5. Repeats come to their documents' texts, are united and cut.

Defined cases: null and empty texts are no bytes; documents are ordered by doc_id (nulls first), then by
text hash; rows equal in both are one document, and each gets its result; texts shorter than
`length` stay whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siltbed.llm.common import EXCHANGE, FLUSH, U, Polynomial, batches, blobs_by_bucket, bucket_of, buckets, doc_bucket, document_batches, exchanged, freeze, joined, mix, nullable_ids, pack, runs, text_blobs, text_columns, thaw

LENGTH, GRAM = 100, 32
#: Kinds of blobs, in the order in which a bucket reads them.
SPANS, COPIES, FRAGMENTS, STRINGS, TEXTS = 0, 1, 2, 3, 5
#: Differing fragments of an anchor from which on its strings are dealt by themselves.
HOT = 1024
#: Bytes of a text that are searched for anchors at once, and suffixes that are sorted at once.
SEGMENT, SUFFIXES = 1 << 19, 60_000
_LOW = U((1 << 22) - 1)


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(h, fh, doc, pos, count): of each fragment the hash of its anchor, a hash of its bytes and its
    anchor's offset, its document, its start there, and how many strings it holds."""
    none = (np.empty(0, U), np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    n = len(data)
    if n < length:
        return none
    doc_of = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.flatnonzero(doc_of[: n - length + 1] == doc_of[length - 1 :])
    if not len(start):
        return none
    poly = Polynomial(data)
    g = poly.grams(gram)
    low = (g & ~_LOW) | np.arange(len(g), dtype=U)
    want, width = length - gram + 1, 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := want - width:
        low = np.minimum(low[:-rest], low[rest:])
    anchor = (low[start] & _LOW).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (doc_of[start[1:]] != doc_of[start[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1
    s0, s1, at = start[first], start[last], anchor[first]
    with np.errstate(over="ignore"):
        fh = mix(poly.ranges(s0, s1 + length) + (at - s0).astype(U) * U(0x9E3779B97F4A7C15))
    doc = doc_of[s0]
    return g[at], fh, doc, s0 - off[doc], s1 - s0 + 1


def segments(data: np.ndarray, off: np.ndarray, length: int):
    """(first document, base, bytes, offsets): short documents together, long ones in overlapping parts."""
    for lo, hi in runs(off, SEGMENT):
        a, b = off[lo], off[hi]
        if b - a <= SEGMENT:
            yield lo, 0, data[a:b], off[lo : hi + 1] - a
        else:
            for at in range(0, b - a - length + 1, SEGMENT - length + 1):
                part = data[a + at : min(b, a + at + SEGMENT)]
                yield lo, at, part, np.array([0, len(part)])


class Spans:
    """Gathers repeats (document, start, length) and sends them to the documents' buckets."""

    def __init__(self, parts: int):
        self.parts, self.held, self.size = parts, [], 0

    def add(self, ids, thash, start, length):
        if len(ids):
            self.held.append((ids, thash, start.astype(np.int64), length.astype(np.int64)))
            self.size += 32 * len(ids)
        if self.size > FLUSH:
            yield from self.flush()

    def flush(self):
        if self.held:
            ids, thash, start, length = (np.concatenate([x[k] for x in self.held]) for k in range(4))
            self.held, self.size = [], 0
            ids, thash, start, length = united(ids, thash, start, length)
            for b, blob in pack({"ids": ids, "thash": thash, "start": start, "length": length}, doc_bucket(ids, thash, self.parts), self.parts):
                yield b, SPANS, blob


def united(ids, thash, start, length):
    """Sorted by document and start, overlapping and touching ones as one."""
    if not len(ids):
        return ids, thash, start, length
    order = np.lexsort((start, thash, ids))
    ids, thash, start, end = ids[order], thash[order], start[order], (start + length)[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (thash[1:] != thash[:-1])
    # the running maximum of the ends within a document: documents are set apart by a large step
    step = (np.cumsum(fresh) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + step)
    begin = np.ones(len(ids), bool)
    begin[1:] = fresh[1:] | ((start + step)[1:] > reach[:-1])
    first = np.flatnonzero(begin)
    last = np.concatenate([first[1:], [len(ids)]]) - 1
    return ids[first], thash[first], start[first], reach[last] - step[first] - start[first]


def interval_tree(lcp: list[int], least: int):
    """(lcp, left, right) of the intervals of a suffix array, from the common prefix lengths of its
    neighbours (lcp[i]: of i and i + 1), children before parents, of at least `least`."""
    stack: list[tuple[int, int]] = []  # (lcp, left)
    for i, x in enumerate([*lcp, 0]):
        left = i
        while stack and stack[-1][0] > x:
            value, left = stack.pop()
            yield value, left, i
        if x >= least and (not stack or stack[-1][0] < x):
            stack.append((x, left))


def ranks(ids: np.ndarray, thash: np.ndarray) -> np.ndarray:
    """The place of each document in the order; rows of one document have one."""
    order = np.lexsort((thash, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (thash[order][1:] != thash[order][:-1])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new)
    return out


def inner_nodes(frag, start, key, size, left, data, off, least: int):
    """(length, rows) of the maximal repeats among differing fragments. Rows are suffixes: `start` in
    fragment `frag`, whose bytes are data[off[frag]:off[frag + 1]]; key: a hash of a suffix's first
    `least` bytes, size: its bytes, left: the byte before it or -1."""
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[back] > 1)
    if not len(shared):
        return
    frag, start, key, size, left = (x[shared] for x in (frag, start, key, size, left))
    width = max(1, int(size.max()) - least)
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    more = size - least
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[np.minimum(off[frag] + start + least, len(data))].copy()
    table[np.arange(width) >= more[:, None]] = 0
    # the size comes last, so that padding and real zero bytes don't mix
    keyed = np.concatenate([key.astype(">u8").view(np.uint8).reshape(-1, 8), table, more.astype(">u4").view(np.uint8).reshape(-1, 4)], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 12}").ravel(), kind="stable")
    keyed, key, more, left = keyed[order], key[order], more[order], left[order]
    differ = keyed[1:, 8:-4] != keyed[:-1, 8:-4]
    lcp = np.where(differ.any(1), differ.argmax(1), width)
    lcp = np.where(key[1:] == key[:-1], np.minimum(lcp, np.minimum(more[1:], more[:-1])) + least, 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (lcp > 0).view(np.int8), [0]])))
    values = lcp.tolist()
    order = shared[order]
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # suffixes a to b
        if b - a == 1:
            if left[a] < 0 or left[a] != left[b]:
                yield values[a], order[a : b + 1]
            continue
        for value, lo, hi in interval_tree(values[a:b], least):
            seen = left[a + lo : a + hi + 1]
            if seen.min() < 0 or (seen != seen[0]).any():  # they can't all be extended to the left
                yield value, order[a + lo : a + hi + 1]


def maximal_repeats(owner, rank, pos, sizes, suffixes=None, least: int = LENGTH):
    """(occurrence, start, length) of all occurrences of maximal repeats but the first of each.

    Occurrences are rows (owner: their fragment, rank: their document's place, pos), those of a
    fragment together, earliest first; sizes: bytes by fragment. suffixes: (frag, start, key, size,
    left, data, off), as inner_nodes() takes them, of fragments that differ."""
    lead = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))  # by fragment
    first = lead[owner]
    copy = np.flatnonzero((rank != rank[first]) | (pos != pos[first]))  # leaves
    out = [(copy, np.zeros(len(copy), np.int64), sizes[owner[copy]])]
    if suffixes is not None:
        frag, start = suffixes[0], suffixes[1]
        of, at = rank[lead[frag]], pos[lead[frag]] + start
        for value, rows in inner_nodes(*suffixes, least):
            if len(rows) == 2:
                low = rows[0] if (of[rows[0]], at[rows[0]]) <= (of[rows[1]], at[rows[1]]) else rows[1]
            else:
                low = rows[np.lexsort((at[rows], of[rows]))[0]]
            rest = rows[(of[rows] != of[low]) | (at[rows] != at[low])]
            out.append((lead[frag[rest]], start[rest], np.full(len(rest), value)))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> tuple[DataFrame, int]:
    """Blobs of the repeats of each document, by the bucket of the document; the number of buckets."""
    parts = buckets(docs)

    def find(it):
        out, held, size = Spans(parts), [], 0

        def rows():
            base, lists = 0, [[] for _ in range(7)]
            for ids, thash, found in held:
                for column, x in zip(lists, (ids, thash, found[0], found[1], found[2] + base, found[3], found[4])):
                    column.append(x)
                base += len(ids)
            ids, thash, h, fh, doc, pos, count = (np.concatenate(x) for x in lists)
            rank = ranks(ids, thash)
            order = np.lexsort((pos, rank[doc], h, fh))
            h, fh, doc, pos, count = (x[order] for x in (h, fh, doc, pos, count))
            first = np.ones(len(h), bool)
            first[1:] = (fh[1:] != fh[:-1]) | (h[1:] != h[:-1])
            at, start, size_ = maximal_repeats(np.cumsum(first) - 1, rank[doc], pos, count[first] + length - 1)
            yield from out.add(ids[doc[at]], thash[doc[at]], pos[at] + start, size_)
            h, fh, doc, pos, count = (x[first] for x in (h, fh, doc, pos, count))
            by = bucket_of(mix(h), parts)  # anchors are minima: their own high bits are uneven
            sort = np.argsort(by, kind="stable")
            edges = np.searchsorted(by[sort], np.arange(parts + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own = sort[edges[b] : edges[b + 1]]
                used, local = np.unique(doc[own], return_inverse=True)
                yield int(b), FRAGMENTS, freeze({"ids": ids[used], "thash": thash[used], "h": h[own].astype(np.uint32), "fh": fh[own], "doc": local.astype(np.uint32), "pos": pos[own].astype(np.uint32), "count": count[own].astype(np.uint32)})

        for ids, _, thash, data, off in document_batches(it):
            for lo, base, part, o in segments(data, off, length):
                h, fh, doc, pos, count = anchors(part, o, length)
                if len(h):
                    held.append((ids[lo : lo + len(o) - 1], thash[lo : lo + len(o) - 1], (h, fh, doc, pos + base, count)))
                    size += 40 * len(h)
                if size > FLUSH:
                    yield from rows()
                    held, size = [], 0
        if held:
            yield from rows()
        yield from out.flush()

    def meet(it):
        """By anchor: its fragments with their copies, and requests for the bytes of differing ones."""
        for bucket, blobs in blobs_by_bucket(it):
            for kind, blob in blobs:
                if kind == SPANS:
                    yield bucket, SPANS, blob
            x = joined([b for kind, b in blobs if kind == FRAGMENTS], ["ids", "thash", "h", "fh", "doc", "pos", "count"], [np.int64, np.int64, np.uint32, U, np.int64, np.uint32, np.uint32])
            ids, thash, rank = x["ids"], x["thash"], ranks(x["ids"], x["thash"])
            _, back, times = np.unique(x["h"], return_inverse=True, return_counts=True)
            several = np.flatnonzero(times[back] > 1)
            h, fh, doc, pos, count = (x[k][several] for k in ("h", "fh", "doc", "pos", "count"))
            if not len(h):
                continue
            order = np.lexsort((pos, rank[doc], fh, h))
            h, fh, doc, pos, count = (v[order] for v in (h, fh, doc, pos, count))
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (fh[1:] != fh[:-1])
            yield bucket, COPIES, freeze({"owner": (np.cumsum(first) - 1).astype(np.uint32), "id": ids[doc], "th": thash[doc], "pos": pos, "count": count[first]})
            h, doc, pos, count = (v[first] for v in (h, doc, pos, count))
            _, back, times = np.unique(h, return_inverse=True, return_counts=True)
            ask = np.flatnonzero(times[back] > 1)
            if len(ask):
                number = ask.astype(U) | U(bucket) << U(32)
                doc, pos, count, apart = doc[ask], pos[ask], count[ask], times[back][ask] > hot
                by = doc_bucket(ids[doc], thash[doc], parts)
                yield from ((b, FRAGMENTS, blob) for b, blob in pack({"ids": ids[doc], "thash": thash[doc], "f": number, "h": h[ask], "pos": pos, "count": count, "apart": apart}, by, parts))

    def fetch(it):
        """By document: the bytes that are asked for."""
        for bucket, blobs in blobs_by_bucket(it):
            known = joined([b for kind, b in blobs if kind == SPANS], ["ids", "thash", "start", "length"], [np.int64] * 4)
            if len(known["ids"]):
                ids, thash, start, size = united(known["ids"], known["thash"], known["start"], known["length"])
                yield bucket, SPANS, freeze({"ids": ids, "thash": thash, "start": start, "length": size})
            for kind, blob in blobs:
                if kind == COPIES:
                    yield bucket, COPIES, blob
            asked = joined([b for kind, b in blobs if kind == FRAGMENTS], ["ids", "thash", "f", "h", "pos", "count", "apart"], [np.int64, np.int64, U, np.uint32, np.uint32, np.uint32, bool])
            if not len(asked["ids"]):
                continue
            order = np.lexsort((asked["thash"], asked["ids"]))
            asked = {k: v[order] for k, v in asked.items()}
            new = np.ones(len(order), bool)
            new[1:] = (asked["ids"][1:] != asked["ids"][:-1]) | (asked["thash"][1:] != asked["thash"][:-1])
            edge = np.append(np.flatnonzero(new), len(order))
            place = {(i, t): k for k, (i, t) in enumerate(zip(asked["ids"][edge[:-1]].tolist(), asked["thash"][edge[:-1]].tolist()))}
            held, done, size = [], set(), 0

            def rows():
                own = np.concatenate([r for r, _ in held])
                data = np.concatenate([d for _, d in held])
                count = asked["count"][own].astype(np.int64)
                off = np.concatenate([[0], np.cumsum(count + length - 1)])
                by = (asked["f"][own] >> U(32)).astype(np.int64)
                whole = ~asked["apart"][own]
                for b in np.unique(by[whole]):
                    sel = np.flatnonzero(whole & (by == b))
                    r = own[sel]
                    yield int(b), FRAGMENTS, freeze({"f": asked["f"][r].astype(np.uint32), "h": asked["h"][r], "len": count[sel] + length - 1, "data": np.concatenate([data[off[i] : off[i + 1]] for i in sel])}, 3)
                apart = np.flatnonzero(~whole)
                if len(apart):
                    # every string, from its start to the fragment's end, by its first bytes
                    sel = np.repeat(apart, count[apart])
                    start = np.arange(len(sel)) - np.repeat(np.cumsum(count[apart]) - count[apart], count[apart])
                    lo, hi = off[sel] + start, off[sel + 1]
                    key = Polynomial(data).ranges(lo, lo + length)
                    left = np.where(start > 0, data[np.maximum(lo - 1, 0)].astype(np.int16), -1).astype(np.int16)
                    r, to = own[sel], bucket_of(mix(key), parts)
                    for b in np.unique(to):
                        k = np.flatnonzero(to == b)
                        yield int(b), STRINGS, freeze({"key": key[k], "left": left[k], "id": asked["ids"][r[k]], "th": asked["thash"][r[k]], "pos": asked["pos"][r[k]].astype(np.int64) + start[k], "len": hi[k] - lo[k], "data": np.concatenate([data[a:z] for a, z in zip(lo[k], hi[k])])}, 3)

            for kind, blob in blobs:
                if kind != TEXTS:
                    continue
                x = thaw(blob)
                off = np.concatenate([[0], np.cumsum(x["len"])])
                for i, key in enumerate(zip(x["ids"].tolist(), x["thash"].tolist())):
                    if (k := place.get(key)) is None or k in done:
                        continue
                    done.add(k)
                    own = np.arange(edge[k], edge[k + 1])
                    a = off[i] + asked["pos"][own].astype(np.int64)
                    n = asked["count"][own].astype(np.int64) + length - 1
                    at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    held.append((own, x["data"][at]))
                    size += len(at)
                    if size > FLUSH // 2:
                        yield from rows()
                        held, size = [], 0
            if held:
                yield from rows()

    def compare(it):
        """By anchor, and by string where an anchor has very many fragments: the interval trees."""
        out = Spans(parts)
        for bucket, blobs in blobs_by_bucket(it):
            for kind, blob in blobs:
                if kind == SPANS:
                    yield bucket, SPANS, blob
                elif kind == COPIES:
                    x = thaw(blob)
                    rank = ranks(x["id"], x["th"])
                    owner, pos, sizes = x["owner"].astype(np.int64), x["pos"].astype(np.int64), x["count"].astype(np.int64) + length - 1
                    names = ["f", "h", "len", "data"]
                    y = joined([b for k, b in blobs if k == FRAGMENTS], names, [np.uint32, np.uint32, np.int64, np.uint8])
                    off = np.concatenate([[0], np.cumsum(y["len"])])
                    order = np.lexsort((y["f"], y["h"]))  # anchor by anchor
                    first, number = np.searchsorted(owner, np.arange(len(sizes) + 1)), y["f"][order].astype(np.int64)
                    last = np.append(np.flatnonzero(np.diff(y["h"][order].astype(np.int64))) + 1, len(order)) if len(order) else np.empty(0, np.int64)
                    load = np.concatenate([[0], np.cumsum(y["len"][order] - length + 1)])
                    # all leaves at once, then inner nodes of anchors with up to SUFFIXES suffixes together
                    at, start, size = maximal_repeats(owner, rank, pos, sizes)
                    yield from out.add(x["id"][at], x["th"][at], pos[at] + start, size)
                    lo = 0
                    while lo < len(order):
                        hi = int(last[max(np.searchsorted(last, lo, "right"), np.searchsorted(load[last], load[lo] + SUFFIXES, "right") - 1)])
                        own = order[lo:hi]
                        n = y["len"][own] - length + 1
                        frag = np.repeat(np.arange(hi - lo), n)
                        begin = np.arange(len(frag)) - np.repeat(np.cumsum(n) - n, n)
                        data = np.concatenate([y["data"][off[i] : off[i + 1]] for i in own])
                        o = np.concatenate([[0], np.cumsum(y["len"][own])])
                        place = o[frag] + begin
                        left = np.where(begin > 0, data[np.maximum(place - 1, 0)].astype(np.int64), -1)
                        key = Polynomial(data).ranges(place, place + length)
                        f = number[lo:hi]
                        lead = first[f]  # each fragment by its earliest copy
                        at, start, size = maximal_repeats(np.arange(hi - lo), rank[lead], pos[lead], sizes[f], (frag, begin, key, y["len"][own][frag] - begin, left, data, o), length)
                        yield from out.add(x["id"][lead[at]], x["th"][lead[at]], pos[lead[at]] + start, size)
                        lo = hi
            x = joined([b for kind, b in blobs if kind == STRINGS], ["key", "left", "id", "th", "pos", "len", "data"], [U, np.int16, np.int64, np.int64, np.int64, np.int64, np.uint8])
            if len(x["key"]):
                frag = np.arange(len(x["key"]))
                off = np.concatenate([[0], np.cumsum(x["len"])])
                at, start, size = maximal_repeats(frag, ranks(x["id"], x["th"]), x["pos"], x["len"], (frag, np.zeros(len(frag), np.int64), x["key"], x["len"], x["left"].astype(np.int64), x["data"], off), length)
                yield from out.add(x["id"][at], x["th"][at], x["pos"][at] + start, size)
        yield from out.flush()

    def packed(f):
        return lambda it: batches(f(it))

    met = exchanged(text_columns(docs).mapInArrow(packed(find), EXCHANGE), parts).mapInArrow(packed(meet), EXCHANGE)
    fetched = exchanged(met.unionByName(text_blobs(docs, parts, TEXTS)), parts).mapInArrow(packed(fetch), EXCHANGE)
    return exchanged(fetched, parts).mapInArrow(packed(compare), EXCHANGE), parts


def removed(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, text (what is left, as bytes), n_bytes, and the removed runs' starts and ends of every
    document."""
    found, parts = spans(docs, length, hot)

    def run(it):
        for _, blobs in blobs_by_bucket(it):
            x = joined([b for kind, b in blobs if kind == SPANS], ["ids", "thash", "start", "length"], [np.int64] * 4)
            ids, thash, start, size = united(x["ids"], x["thash"], x["start"], x["length"])
            at: dict[tuple[int, int], list[int]] = {}
            for k, key in enumerate(zip(ids.tolist(), thash.tolist())):
                at.setdefault(key, []).append(k)
            for kind, blob in blobs:
                if kind != TEXTS:
                    continue
                t = thaw(blob)
                off = np.concatenate([[0], np.cumsum(t["len"])])
                for lo, hi in runs(off, 4 << 20):
                    texts, starts, ends = [], [], []
                    for i in range(lo, hi):
                        raw = t["data"][off[i] : off[i + 1]].tobytes()
                        own = at.get((int(t["ids"][i]), int(t["thash"][i])), ())
                        a, b = [int(start[k]) for k in own], [int(start[k] + size[k]) for k in own]
                        texts.append(b"".join(raw[p:q] for p, q in zip([0, *b], [*a, len(raw)])) if own else raw)
                        starts.append(a)
                        ends.append(b)
                    yield pa.RecordBatch.from_arrays([nullable_ids(t["ids"][lo:hi], t["null"][lo:hi]), pa.array(texts, pa.binary()), pa.array(t["len"][lo:hi], pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], ["doc_id", "text", "n_bytes", "starts", "ends"])

    return exchanged(found.unionByName(text_blobs(docs, parts, TEXTS)), parts).mapInArrow(run, "doc_id long, text binary, n_bytes long, starts array<long>, ends array<long>")


def digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""

    def run(it):
        for batch in it:
            gone = [sum(b) - sum(a) for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
            n = [len(a) for a in batch.column("starts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(gone, pa.int64()), pa.array(n, pa.int64()), pa.array([sha256(t.as_py()).hexdigest() for t in batch.column("text")])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return removed(docs, length, hot).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
