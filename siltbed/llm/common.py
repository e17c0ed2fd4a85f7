"""What the corpus operators share: byte views of Arrow text columns, vectorised hashes, packed
exchanges and connected components.

A document is named by its `doc_id` and, where ids repeat, by a hash of its text: rows that agree in
both are the same document. Null ids are carried as such.

Packed exchanges: operators that must bring many small things (hashes, spans, texts) together send
them as blobs, one row for each (task, bucket), instead of one row each. A map task holds at most
about FLUSH bytes before it lets its blobs go; a reducer holds one bucket. The number of buckets
grows with the input: see buckets().
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once; a longer document is worked on alone.
CHUNK = 1 << 19
#: Bytes that a map task gathers before it sends its blobs.
FLUSH = 16 << 20
#: Edges of a graph that one task contracts.
LOCAL = 200_000
#: Bytes of files to a bucket of an exchange.
BUCKET = 128 << 20
NULL_ID = np.iinfo(np.int64).min
U = np.uint64


# ---------------------------------------------------------------- session

def buckets(df: DataFrame) -> int:
    """How many buckets an exchange of df's texts has: one for each shuffle partition that the session
    names, or one for each BUCKET bytes of the files that df reads if those are more. Other sources than
    files report no size, and what a plan makes of that after a projection looks like one: they don't count."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    files = [leaf for leaf in (leaves.apply(k) for k in range(leaves.size())) if leaf.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation")]
    size = sum(int(str(leaf.stats().sizeInBytes())) for leaf in files)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where it is unset a folder of this
    machine will do only if all executors are on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "siltbed-checkpoint")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder. Spark deletes them once nothing refers to the
    result if spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed such that its partitioning and order stay known, so that joins and aggregates on its
    keys needn't move it. An adaptive plan doesn't tell these, so this one is made without."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        own = df.select("*")  # planned anew
        done = checkpointed(own)
    finally:
        conf.set(name, before)
    unshuffled(own)
    return done


def unshuffled(df: DataFrame) -> None:
    """Deletes the shuffle files of a frame whose own plan, made without adaptive execution, is not run
    again. Spark keeps these past released(), until much of a next step is done."""
    cleaner, left = df.sparkSession.sparkContext._jsc.sc().cleaner(), [df._jdf.queryExecution().executedPlan()]
    while left and cleaner.isDefined():
        node = left.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            cleaner.get().doCleanupShuffle(node.shuffleDependency().shuffleId(), False)
        below = node.children()
        left += [below.apply(k) for k in range(below.size())]


def released(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles and checkpoints that nothing refers to any more. It learns
    of them when the driver's heap is collected, which without this may be long after they pile up."""
    spark.sparkContext._jvm.System.gc()


def quoted(name: str) -> str:
    """A column's name as an identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def trim() -> None:
    """Gives memory that a reused worker's earlier tasks have freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- byte views

def text_hash(text: Column) -> Column:
    """The hash that tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def text_columns(docs: DataFrame) -> DataFrame:
    """doc_id, is_null (of doc_id), thash (64-bit hash of the text) and text, null texts as empty."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NULL_ID))).alias("doc_id"),
        docs["doc_id"].isNull().alias("is_null"),
        text_hash(docs["text"]).alias("thash"),
        text.alias("text"),
    )


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the n + 1 offsets into them, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(off: np.ndarray, limit: int = CHUNK):
    """Index ranges of consecutive documents of at most `limit` bytes together, or of a longer one."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


# ---------------------------------------------------------------- hashes

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(salt)) * U(0x9E3779B97F4A7C15))


_BYTE = seeds(256, 17)
_BASE = 0x9E6C63D0876A9A35
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2^64."""
    if len(_POWERS[0]) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, U(base), U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


class Polynomial:
    """Hashes of any range of a byte buffer in constant time each, from prefix sums modulo 2^64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U))

    def grams(self, k: int) -> np.ndarray:
        """Of the k bytes at each place."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n]) if n > 0 else np.empty(0, U)


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of documents that lie one after another. inside: by byte, whether
    it belongs to a word."""
    member = inside[data]
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = member[edge]
    last[edge - 1] = member[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return _LOWER[data]


#: Bytes that are no white space: words are `[^\x20\x09-\x0D]+`.
PLAIN = np.ones(256, bool)
PLAIN[[32, 9, 10, 11, 12, 13]] = False


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each document, and the document that each belongs to. A
    document of 1 to n - 1 words has its whole sequence as its one shingle; one without words none."""
    low = lowered(data)
    start, end = words(low, off, PLAIN)
    if not len(start):
        return np.empty(0, U), np.empty(0, np.int64)
    h = Polynomial(low).ranges(start, end)
    doc = np.searchsorted(off, start, "right") - 1
    weight = seeds(n, 1000)
    with np.errstate(over="ignore"):
        count = len(h) - n + 1
        full, owner = np.empty(0, U), np.empty(0, np.int64)
        if count > 0:
            acc = np.zeros(count, U)
            for i in range(n):
                acc += h[i : i + count] * weight[i]
            same = doc[:count] == doc[n - 1 :]
            full, owner = mix(acc[same]), doc[:count][same]
        total = np.bincount(doc, minlength=len(off) - 1)
        short = np.flatnonzero((total > 0) & (total < n))
        if len(short):
            at = np.searchsorted(doc, short)
            acc = np.zeros(len(short), U)
            for i in range(n - 1):
                has = total[short] > i
                acc[has] += h[at[has] + i] * weight[i]
            full = np.concatenate([full, mix(acc + total[short].astype(U))])
            owner = np.concatenate([owner, short])
    return full, owner


def distinct(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by owner and hash, each pair once."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, owner


# ---------------------------------------------------------------- packed exchanges

def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Even over the high bits, so that a bucket is also a range of hashes."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int32)


def doc_bucket(ids: np.ndarray, thash: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return bucket_of(mix(ids.view(U) * U(0x9E3779B97F4A7C15) ^ thash.view(U)), n)


def pack(arrays: dict[str, np.ndarray], by: np.ndarray, n: int, level: int = 1):
    """(bucket, blob) for each bucket that has rows. Byte strings come as a pair of columns: see Packer."""
    order = np.argsort(by, kind="stable")
    edges = np.searchsorted(by[order], np.arange(n + 1))
    arrays = {k: v[order] for k, v in arrays.items()}
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), freeze({k: v[edges[b] : edges[b + 1]] for k, v in arrays.items()}, level)


def freeze(arrays: dict[str, np.ndarray], level: int = 1) -> bytes:
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode()
    return zstandard.ZstdCompressor(level=level).compress(b"".join([len(head).to_bytes(4, "little"), head, *(np.ascontiguousarray(v).tobytes() for v in arrays.values())]))


def thaw(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for part in raw[4:at].decode().split(";"):
        name, kind, n = part.split(",")
        dtype = np.dtype(kind)
        out[name] = np.frombuffer(raw, dtype, int(n), at)
        at += int(n) * dtype.itemsize
    return out


def joined(blobs: list[bytes], names: list[str], dtypes: list) -> dict[str, np.ndarray]:
    """The arrays of several blobs, one after another. A column `doc` counts on across the blobs:
    it points into `ids` and `thash`."""
    parts, base = {k: [np.empty(0, d)] for k, d in zip(names, dtypes)}, 0
    for blob in blobs:
        x = thaw(blob)
        if "doc" in x:
            x["doc"] = x["doc"].astype(np.int64) + base
            base += len(x["ids"])
        for k in names:
            parts[k].append(x[k])
    return {k: np.concatenate(v) for k, v in parts.items()}


EXCHANGE = "bucket int, kind int, blob binary"


def blob_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["bucket", "kind", "blob"],
    )


def batches(rows, limit: int = 8 << 20):
    """Arrow batches of (bucket, kind, blob) rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > limit:
            yield blob_batch(held)
            held, size = [], 0
    if held:
        yield blob_batch(held)


def exchanged(df: DataFrame, n: int) -> DataFrame:
    """Bucket b to partition b, smaller kinds first."""
    return df.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def blobs_by_bucket(batches_in):
    """(bucket, [(kind, blob), ...]) from batches sorted by bucket and kind; one bucket is held at once."""
    bucket, held = None, []
    for batch in batches_in:
        for b, kind, blob in zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist(), batch.column("blob")):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, []
            held.append((kind, blob.as_py()))
    if held:
        yield bucket, held


class TextPacker:
    """Gathers whole documents and sends them to the buckets of their names as compressed blobs."""

    def __init__(self, n: int, kind: int):
        self.n, self.kind, self.parts, self.size = n, kind, [], 0

    def add(self, ids, null, thash, data, off):
        self.parts.append((ids, null, thash, data, off))
        self.size += len(data)
        if self.size > FLUSH:
            yield from self.flush()

    def flush(self):
        if self.parts:
            ids, null, thash = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
            lengths = np.concatenate([np.diff(p[4]) for p in self.parts])
            data = np.concatenate([p[3] for p in self.parts])
            off = np.concatenate([[0], np.cumsum(lengths)])
            by = doc_bucket(ids, thash, self.n)
            order = np.argsort(by, kind="stable")
            edges = np.searchsorted(by[order], np.arange(self.n + 1))
            for b in np.flatnonzero(np.diff(edges)):
                own = order[edges[b] : edges[b + 1]]
                yield int(b), self.kind, freeze({"ids": ids[own], "null": null[own], "thash": thash[own], "len": lengths[own], "data": np.concatenate([data[off[i] : off[i + 1]] for i in own])}, 3)
            self.parts, self.size = [], 0


def document_batches(batches_in):
    """ids, null flags, text hashes, bytes and offsets of each Arrow batch made by text_columns()."""
    for batch in batches_in:
        if batch.num_rows:
            data, off = views(batch.column("text"))
            yield (batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("is_null").to_numpy(zero_copy_only=False).astype(bool), batch.column("thash").to_numpy(zero_copy_only=False), data, off)


def text_blobs(docs: DataFrame, n: int, kind: int) -> DataFrame:
    """All documents, to the buckets of their names."""

    def run(it):
        packer = TextPacker(n, kind)

        def rows():
            for part in document_batches(it):
                yield from packer.add(*part)
            yield from packer.flush()

        yield from batches(rows())

    return text_columns(docs).mapInArrow(run, EXCHANGE)


def nullable_ids(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=null)


# ---------------------------------------------------------------- connected components

class UnionFind:
    """Components over long ids; the root is the smallest id."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if a < b else (b, a)
            self.parent[high] = low


def _contracted(it):
    """The edges of a task as stars: every id with the smallest of its local component."""
    uf = UnionFind()
    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            uf.union(a, b)
    nodes = list(uf.parent)
    for lo in range(0, len(nodes), 100_000):
        part = nodes[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([uf.find(x) for x in part], pa.int64())], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60, local: int = LOCAL) -> DataFrame:
    """(node, component) for every node of the edges (u, v); component is the smallest node reachable.

    Tasks of about `local` edges contract them to stars; where one task holds all, that is the result.
    Otherwise large-star and small-star steps alternate until a whole round changes nothing; every round
    is written to the checkpoint folder. A node's neighbours are never listed in one place: both steps
    are a minimum by key and a join."""
    edges = checkpointed(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u != v").distinct())
    parts = max(1, -(-edges.count() // local))
    stars = checkpointed(edges.repartition(parts).mapInArrow(_contracted, "u long, v long").distinct())

    def step(e: DataFrame, large: bool) -> DataFrame:
        # both directions for the large star; towards smaller ones only for the small star
        way = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = way.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        with_low = way.join(low, "u")
        moved = with_low.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else with_low.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        return moved.where("u != v").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()

    def told(e: DataFrame) -> DataFrame:
        found = e.where("u != v").groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
        return found.union(found.select(F.col("component").alias("node"), "component").distinct())

    if parts == 1:
        return told(stars)
    stars = stars.where("u != v")
    before = mark(stars)
    for _ in range(rounds):
        stars = checkpointed(step(step(stars, True), False))
        now = mark(stars)
        if now == before:
            return told(stars)
        before = now
    raise RuntimeError("components did not settle")
