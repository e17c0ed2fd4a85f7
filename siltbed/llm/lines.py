"""Line dedup that returns keep bitmaps.

A line's key is the line with `[\\x20\\x09-\\x0D]` stripped at both ends and A-Z in lower case. Keys of at
least `min_chars` code points that stand in at least `min_docs` documents lose all their lines but
those of the largest doc_id that holds them.

Occurrences (hash of the key, document, positions) are range-partitioned by hash and then document,
so that a common line spreads over as many partitions as it needs; in each partition they are
sorted by hash, document (largest first) and read as a stream: the first document of a key keeps its
lines, the others' lines go once `min_docs` documents are seen. Of keys that lie at the edges of
partitions, at most min_docs documents a partition go to the driver, which settles them. Positions
to drop come together by document and become a zlib-compressed bitmap of the lines to keep. Texts
take no part in that; they move once when bitmaps are applied, in a join by document.

Defined cases: a null or empty text is one empty line; rows that share a doc_id count as one
document and all keep or lose a key's lines alike; documents that lose nothing have no bitmap; a
null doc_id is a document smaller than all others; an empty table gives no rows; other columns are
not read, or given back as they are, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import NULL_ID, buckets, checkpointed, nullable_ids, quoted, text_columns, text_hash

MIN_CHARS, MIN_DOCS = 40, 5
_SPACE = " \t\n\v\f\r"
_LOWER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(_SPACE).translate(_LOWER)


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, doc_id, thash, n_lines, positions), one row for each key of a document."""

    def run(it):
        for batch in it:
            out = [[], [], [], [], []]
            for i, (doc_id, thash, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("thash").to_pylist(), batch.column("text"))):
                lines = text.as_py().split("\n")
                found = defaultdict(list)
                for k, line in enumerate(lines):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars:
                        found[blake2b(key.encode(), digest_size=16).digest()].append(k)
                for key, at in found.items():
                    for column, value in zip(out, (key, doc_id, thash, len(lines), at)):
                        column.append(value)
                if len(out[0]) > 50_000:
                    yield _rows(out)
                    out = [[], [], [], [], []]
            if out[0]:
                yield _rows(out)

    return text_columns(docs).mapInArrow(run, "key binary, doc_id long, thash long, n_lines int, positions array<int>")


def _rows(out):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.list_(pa.int32()))], ["key", "doc_id", "thash", "n_lines", "positions"])


def _stream(it):
    for batch in it:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, thash, n_lines, n_dropped, keep) of the documents that lose lines. keep: zlib of the
    bits, one for each line, 1 to keep, first line in the highest bit. doc_id is NULL_ID for null."""
    n = buckets(docs)
    order = [F.col("key"), F.col("doc_id").desc(), F.col("thash")]
    # written first: range partitioning reads its input twice, to sample the limits and to deal it out
    found = checkpointed(occurrences(docs, min_chars))
    rows = checkpointed(found.repartitionByRange(n, *order).sortWithinPartitions(*order))

    def edges(it):
        """Of the first and the last key of the partition: up to min_docs documents, largest first."""
        first = last = None
        for key, doc_id, *_ in _stream(it):
            if last is None or key != last[0]:
                if last is not None and first is None:
                    first = last
                last = (key, [])
            if len(last[1]) < min_docs and doc_id not in last[1]:
                last[1].append(doc_id)
        found = [x for x in (first, last) if x is not None]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["key", "docs"])

    seen = defaultdict(set)
    for r in rows.mapInArrow(edges, "key binary, docs array<long>").collect():  # two keys a partition
        seen[bytes(r["key"])] |= set(r["docs"])
    settled = {k: (len(v) >= min_docs, max(v)) for k, v in seen.items()}

    def drops(it):
        """The rows whose lines go."""
        out, held, key, keeper, docs_seen, sure = [], [], None, None, set(), False
        for row in _stream(it):
            if row[0] != key:
                key, held, docs_seen = bytes(row[0]), [], set()
                sure, keeper = settled.get(key, (None, row[1]))  # None: to be counted here
            if sure is None:
                docs_seen.add(row[1])
                if row[1] != keeper:
                    held.append(row)
                if len(docs_seen) >= min_docs:
                    sure = True
                    out += held
                    held = []
            elif sure and row[1] != keeper:
                out.append(row)
            if len(out) > 20_000:
                yield _dropped(out)
                out = []
        if out:
            yield _dropped(out)

    def bits(it):
        for batch in it:
            keep = []
            for n_lines, parts in zip(batch.column("n_lines").to_pylist(), batch.column("parts").to_pylist()):
                b = np.ones(n_lines, bool)
                b[[k for p in parts for k in p]] = False
                keep.append((int(n_lines - b.sum()), zlib.compress(np.packbits(b).tobytes(), 6)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("thash"), batch.column("n_lines"), pa.array([k[0] for k in keep], pa.int32()), pa.array([k[1] for k in keep], pa.binary())], ["doc_id", "thash", "n_lines", "n_dropped", "keep"])

    gone = rows.mapInArrow(drops, "doc_id long, thash long, n_lines int, positions array<int>")
    # a document's lines, as many as its text has
    together = gone.groupBy("doc_id", "thash").agg(F.first("n_lines").alias("n_lines"), F.collect_list("positions").alias("parts"))
    return together.mapInArrow(bits, "doc_id long, thash long, n_lines int, n_dropped int, keep binary")


def _dropped(out):
    return pa.RecordBatch.from_arrays([pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int32()), pa.array([r[4] for r in out], pa.list_(pa.int32()))], ["doc_id", "thash", "n_lines", "positions"])


def cut(text: str, keep: bytes | None) -> tuple[str, int, int]:
    """The text without the lines that go, its lines before, and how many went."""
    if keep is None:
        return text, text.count("\n") + 1, 0
    lines = text.split("\n")
    bit = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    left = [x for x, b in zip(lines, bit) if b]
    return "\n".join(left), len(lines), len(lines) - len(left)


def digests(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document, by applying the bitmaps."""

    def run(it):
        for batch in it:
            found = [cut(t.as_py(), k) for t, k in zip(batch.column("text"), batch.column("keep").to_pylist())]
            null = batch.column("is_null").to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([nullable_ids(batch.column("doc_id").to_numpy(), null), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([sha256(x[0].encode()).hexdigest() for x in found])], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    marks = bitmaps(docs, min_chars, min_docs).select("doc_id", "thash", "keep")
    return text_columns(docs).join(marks, ["doc_id", "thash"], "left").select("doc_id", "is_null", "text", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def applied(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents, all columns, without the lines that go; n_chars, where there is one, follows."""
    marks = bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("name"), F.col("thash").alias("hash"), "keep")
    # the row itself in one column, so that its names meet no others
    own = docs.select(F.struct(*[docs[quoted(c)] for c in docs.columns]).alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(int(NULL_ID))).alias("name"), text_hash(docs["text"]).alias("hash"))
    rows = own.join(marks, ["name", "hash"], "left").select("row", "keep")

    def run(it):
        for batch in it:
            columns, names, keep = batch.column("row").flatten(), [f.name for f in batch.schema.field("row").type], batch.column("keep").to_pylist()
            at = names.index("text")
            new = [t if k is None else cut(t or "", k)[0] for t, k in zip(columns[at].to_pylist(), keep)]
            columns[at] = pa.array(new, columns[at].type)
            if "n_chars" in names:
                c = names.index("n_chars")
                columns[c] = pa.array([old if k is None else len(t) for old, k, t in zip(columns[c].to_pylist(), keep, new)], columns[c].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, docs.schema)
