"""Byte-level BPE: encode texts to ids and ids back to bytes.

Each match of the splitting pattern is encoded by itself; one that is no token as a whole goes through a
segment tree with one leaf for each byte position. A leaf holds the rank of the pair that begins
there, a node the leftmost smallest below it, so the root names the next merge. A merge changes three
leaves, those of the merged part and of its two living neighbours, and the nodes above them: n bytes cost
O(n log n), also when a text is one long run of letters.

The trees of the distinct new pieces of a few documents stand side by side in one array and merge in
step; the last few go on one by one. Each worker keeps the ids of about CACHED pieces of up to
CACHED_CHARS characters, and begins again when it has as many.

Defined cases: null and empty texts have no ids; repeated rows give repeated results; other columns
of the input are not read; a table without rows gives none.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from siltbed.llm.common import runs, text_columns, trim, views

CACHED = 300_000
CACHED_CHARS = 64
#: Bytes of text whose pieces are merged together; a longer document is alone.
TOGETHER = 1 << 20
#: Leaves of trees that merge in step, and how few trees go on one by one.
LEAVES, FEW = 1 << 17, 12
ABSENT = 1 << 62
_POSITION = (1 << 32) - 1


class BytePairs:
    """A vocabulary of byte strings with ranks, and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes = {i: b for b, i in ranks.items()}
        self.seen: dict[str, tuple[int, ...]] = {}
        # every way to make a token of two tokens, by the ids of both
        made = {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        pairs = np.array(list(made), np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.made = np.append(keys[order], ABSENT), np.append(np.array(list(made.values()), np.int64)[order], -1)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    @classmethod
    def read(cls, path: str, pattern: str) -> BytePairs:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where they make none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def merged(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each piece."""
        out: list = [(r,) if (r := self.ranks.get(p)) is not None else None for p in pieces]
        open_ = np.array([i for i, x in enumerate(out) if x is None], np.int64)
        levels = np.array([(len(pieces[i]) - 1).bit_length() for i in open_], np.int64)
        for level in np.unique(levels).tolist():
            rows = open_[levels == level].tolist()
            step = max(1, LEAVES >> level)
            for k in range(0, len(rows), step):
                some = rows[k : k + step]
                for i, ids in zip(some, self.trees([pieces[i] for i in some], level)):
                    out[i] = ids
        return out

    def trees(self, pieces: list[bytes], level: int) -> list[tuple[int, ...]]:
        """The ids of pieces of at most 2^level bytes, no token as a whole, by segment trees."""
        width, size = 1 << level, np.array([len(p) for p in pieces])
        alive = np.arange(width) < size[:, None]  # places where a part begins
        token = np.zeros((len(pieces), width), np.int64)
        token[alive] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 1), (len(pieces), 1))  # by a part's start: the starts beside it
        before = after - 2
        tree = np.full((len(pieces), 2 * width), ABSENT)
        paired = alive[:, 1:]
        found = self.rank(token[:, :-1][paired], token[:, 1:][paired])
        tree[:, width:-1][paired] = np.where(found >= 0, found << 32 | np.nonzero(paired)[1], ABSENT)
        half = width
        while half > 1:
            tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
            half //= 2
        rows = np.arange(len(pieces))
        while True:
            best = tree[rows, 1]
            rows, best = rows[best < ABSENT], best[best < ABSENT]
            if len(rows) <= FEW:
                break
            i, new = best & _POSITION, best >> 32
            j = after[rows, i]
            k = after[rows, j]
            # the parts at i and j are now one, which ends at k
            alive[rows, j], after[rows, i], token[rows, i] = False, k, new
            more, p = k < size[rows], before[rows, i]
            before[rows[more], k[more]] = i[more]
            begun = p >= 0
            right = np.where(more, self.rank(new, token[rows, np.where(more, k, 0)]), -1)
            left = np.where(begun, self.rank(token[rows, np.maximum(p, 0)], new), -1)
            tree[rows, width + j] = ABSENT
            tree[rows, width + i] = np.where(right >= 0, right << 32 | i, ABSENT)
            tree[rows[begun], width + p[begun]] = np.where(left >= 0, left << 32 | p, ABSENT)[begun]
            nodes = [width + i, width + j, width + np.maximum(p, 0)]
            for _ in range(level):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        for r in rows.tolist():
            self.alone(pieces[r], width, tree[r], after[r], before[r], alive[r], token[r])
        ids, edge = token[alive].tolist(), np.concatenate([[0], np.cumsum(alive.sum(1))]).tolist()
        return [tuple(ids[a:b]) for a, b in zip(edge[:-1], edge[1:])]

    def alone(self, piece: bytes, width: int, tree, after, before, alive, token) -> None:
        """Goes on with one tree to the end; changes alive and token."""
        node, nxt, prev, n, rank = tree.tolist(), after.tolist(), before.tolist(), len(piece), self.ranks.get

        def put(i: int, pair: bytes | None) -> None:
            r = None if pair is None else rank(pair)
            at, low = width + i, ABSENT if r is None else r << 32 | i
            while node[at] != low:
                node[at] = low
                if at == 1:
                    return
                if (other := node[at ^ 1]) < low:
                    low = other
                at >>= 1

        while (best := node[1]) < ABSENT:
            i = best & _POSITION
            j = nxt[i]
            nxt[i] = k = nxt[j]
            alive[j], token[i] = False, best >> 32
            put(j, None)
            if k < n:
                prev[k] = i
            put(i, piece[i : nxt[k]] if k < n else None)
            if (p := prev[i]) >= 0:
                put(p, piece[p:k])

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        seen, pieces = self.seen, [self.split(t) for t in texts]
        if len(seen) > CACHED:
            seen.clear()
        new = list(set(chain.from_iterable(pieces)).difference(seen))
        seen.update(zip(new, self.merged([p.encode() for p in new])))
        out = [list(chain.from_iterable(map(seen.__getitem__, p))) for p in pieces]
        for p in new:
            if len(p) > CACHED_CHARS:
                del seen[p]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def encoded(self, column: pa.Array):
        """The ids of each text of a column, in order."""
        _, off = views(column)
        for lo, hi in runs(off, TOGETHER) if len(column) else ():
            yield from self.encode_many(column.slice(lo, hi - lo).to_pylist())

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_LOADED: dict[tuple[str, str], BytePairs] = {}


def tokenizer(path: str, pattern: str) -> BytePairs:
    """One for each worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = BytePairs.read(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every document. path: of a rank file, on every machine."""

    def run(it):
        pairs = tokenizer(path, pattern)
        for batch in it:
            null, ids = batch.column("is_null"), batch.column("doc_id").to_pylist()
            rows = list(pairs.encoded(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([None if x.as_py() else i for x, i in zip(null, ids)], pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_columns(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and bytes of every row of ids; null ids give null bytes."""

    def run(it):
        pairs = tokenizer(path, pattern)
        for batch in it:
            out = [None if x is None else pairs.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of the ids as decimals joined by commas, and of the bytes that
    decoding the ids gives. Encodes and decodes in one pass, document by document."""

    def run(it):
        trim()
        pairs = tokenizer(path, pattern)
        decimal = {i: str(i) for i in pairs.bytes}.__getitem__
        for batch in it:
            n, enc, dec = [], [], []
            for ids in pairs.encoded(batch.column("text")):
                n.append(len(ids))
                enc.append(sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                dec.append(sha256(pairs.decode(ids)).hexdigest())
            doc_id = pc.if_else(batch.column("is_null"), pa.scalar(None, pa.int64()), batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return text_columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def round_trips(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text's bytes again."""

    def run(it):
        trim()
        pairs = tokenizer(path, pattern)
        parts = (batch.slice(lo, hi - lo) for batch in it if batch.num_rows for lo, hi in runs(views(batch.column("text"))[1], 2 << 20))
        for batch in parts:
            rows = list(pairs.encoded(batch.column("text")))
            same = [pairs.decode(x) == t.as_py().encode() for x, t in zip(rows, batch.column("text"))]
            doc_id = pc.if_else(batch.column("is_null"), pa.scalar(None, pa.int64()), batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([len(x) for x in rows], pa.int64()), pa.array(rows, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return text_columns(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")
