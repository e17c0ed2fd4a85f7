"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is labelled good or bad. A line's features are shares and shapes of its bytes and
words, and those of the lines beside it; a 2 x 2 table scores neighbouring labels. The score of a
document is the mean of its lines' forward-backward marginals of `good`, weighted by the lines'
lengths. Trained by maximum conditional likelihood with L2, each line of a labelled document taking
the document's label and documents of both labels weighing alike, on a bounded sample of labelled rows.

Defined cases: null and empty texts are one empty line and get a score like any other; null or absent
labels teach nothing; of several labels of an id the least counts, of several texts of an id the one
with the smallest hash; without labels of both kinds every score is 0.5; repeated rows give repeated
results; an empty table gives no rows; kept() gives all columns back as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltbed.llm.common import PLAIN, Polynomial, runs, text_hash, views, words

#: The fit draws at most so many labelled documents, of at most so many bytes each, and of those the
#: first by hash that have at most so many lines together.
SAMPLE, SAMPLE_BYTES, SAMPLE_LINES = 4000, 200_000, 400_000
L2, STEPS, RATE = 1e-3, 200, 0.1

_KIND = np.full(256, 6, np.int64)  # other punctuation
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[128:] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KIND[ord("!")] = 7
_KIND[ord("|")] = 8
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 9
KINDS = 10


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the documents: features (lines, F), lengths in bytes plus 1, and the number of
    lines of each document."""
    breaks = np.flatnonzero(data == 10)
    # a document of k line ends has k + 1 lines
    per_doc = np.searchsorted(breaks, off[1:]) - np.searchsorted(breaks, off[:-1]) + 1
    start = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    n = len(start)
    line_first = np.concatenate([[0], np.cumsum(per_doc)])
    end = np.concatenate([start[1:], off[-1:]])
    last = np.zeros(n, bool)
    last[line_first[1:] - 1] = True
    end = np.where(last, end, end - 1)  # without the line end
    length = end - start
    line = np.cumsum(np.bincount(start, minlength=len(data) + 1)[: len(data)]) - 1 if len(data) else np.empty(0, np.int64)
    body = data != 10
    kinds = np.bincount(line[body] * KINDS + _KIND[data[body]], minlength=n * KINDS).reshape(n, KINDS)
    share = kinds / np.maximum(length, 1)[:, None]
    a, b = words(data, off, PLAIN)
    count = rep = size = caps = np.zeros(n)
    if len(a):
        h = Polynomial(data).ranges(a, b)
        of = line[a]
        count = np.bincount(of, minlength=n).astype(float)
        size = np.bincount(of, b - a, minlength=n) / np.maximum(count, 1)
        same = np.zeros(len(h), bool)
        for lag in (1, 2, 3):
            same[lag:] |= (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
        rep = np.bincount(of[same], minlength=n) / np.maximum(count, 1)
        caps = np.bincount(of[(_KIND[data[a]] == 1)], minlength=n) / np.maximum(count, 1)
    whole = Polynomial(data).ranges(start, end)
    again = np.zeros(n)
    again[1:] = (whole[1:] == whole[:-1]) & (length[1:] > 0)
    again[line_first[:-1]] = 0
    closed = np.zeros(n)
    if len(data):
        closed = ((length > 0) & np.isin(data[np.maximum(end - 1, 0)], [ord(c) for c in ".?!"])).astype(float)
    own = np.column_stack([share, np.log1p(length) / 5, np.log1p(count) / 4, size / 10, rep, caps, again, closed, (length == 0).astype(float)])
    own[:, :KINDS] = np.sqrt(own[:, :KINDS])
    # the lines beside it, within the document
    up, down = np.zeros_like(own), np.zeros_like(own)
    up[1:], down[:-1] = own[:-1], own[1:]
    firsts = np.zeros(n, bool)
    firsts[line_first[:-1]] = True
    up[firsts], down[last] = 0, 0
    return np.column_stack([np.ones(n), own, (up + down) / 2, firsts, last]).astype(np.float32), length + 1, per_doc


def _layout(per_doc: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Row numbers of the first lines, longest document first, and by step how many documents go on."""
    order = np.argsort(-per_doc, kind="stable")
    active = len(per_doc) - np.searchsorted(np.sort(per_doc), np.arange(int(per_doc.max()) if len(per_doc) else 0), "right")
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])[order]
    return first, active.tolist()


def _norm(a):
    high = a.max(-1, keepdims=True)
    return high + np.log(np.exp(a - high).sum(-1, keepdims=True))


def marginals(node: np.ndarray, edge: np.ndarray, per_doc: np.ndarray, weight: np.ndarray | None = None):
    """By line the log-marginal potentials normalised to probabilities of (bad, good); with weight (by
    line), also the weighted expected counts of neighbouring labels. node: (lines, 2); edge: (2, 2);
    all logarithms."""
    first, active = _layout(per_doc)
    ahead, back = np.zeros_like(node), np.zeros_like(node)
    for t, k in enumerate(active):
        at = first[:k] + t
        a = node[at]
        if t:
            prev = ahead[at - 1][:, :, None] + edge
            high = prev.max(1)
            a = a + high + np.log(np.exp(prev - high[:, None, :]).sum(1))
        ahead[at] = a - _norm(a)  # only differences count
    counts = np.zeros((2, 2))
    for t in range(len(active) - 2, -1, -1):
        k = active[t + 1]
        at = first[:k] + t
        nxt = (node[at + 1] + back[at + 1])[:, None, :] + edge
        high = nxt.max(2)
        b = high + np.log(np.exp(nxt - high[:, :, None]).sum(2))
        back[at] = b - _norm(b)
        if weight is not None:
            pair = ahead[at][:, :, None] + nxt
            pair = np.exp(pair - pair.max((1, 2), keepdims=True))
            counts += (pair * (weight[at] / pair.sum((1, 2)))[:, None, None]).sum(0)
    both = ahead + back
    p = np.exp(both - _norm(both))
    return p if weight is None else (p, counts)


class LineField:
    """The trained field: standardised features, node weights of `good` against `bad`, edge table."""

    def __init__(self, mean, scale, weight, edge):
        self.mean, self.scale, self.weight, self.edge = mean, scale, weight, edge

    def nodes(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weight
        return np.column_stack([-z / 2, z / 2]).astype(np.float64)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        x, length, per_doc = line_features(data, off)
        good = marginals(self.nodes(x), self.edge, per_doc)[:, 1]
        first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
        return np.clip(np.add.reduceat(good * length, first) / np.add.reduceat(length, first), 0.0, 1.0)

    @staticmethod
    def gradient(z, per_doc, label, weight, edge):
        """Of the documents' conditional log-likelihoods, each weighted so that both labels weigh alike,
        by line, less the L2 penalty: with regard to the node weights and the edge table."""
        y = np.repeat(label, per_doc)
        balance = np.array([0.5 / max(1e-9, (label == k).mean()) for k in (0, 1)])[y]
        inner = np.ones(len(y), bool)  # lines with one before them in the document
        inner[np.concatenate([[0], np.cumsum(per_doc)[:-1]])] = False
        seen = np.diag([balance[inner & (y == k)].sum() for k in (0, 1)])  # a document's lines have one label
        s = z @ weight
        p, counts = marginals(np.column_stack([-s / 2, s / 2]), edge, per_doc, balance)
        return z.T @ ((y - p[:, 1]) * balance) / len(y) - L2 * weight, (seen - counts) / len(y) - L2 * edge

    @classmethod
    def fit(cls, x: np.ndarray, per_doc: np.ndarray, label: np.ndarray) -> LineField:
        """label: 0 or 1 by document. Adam on the weighted conditional log-likelihood."""
        mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        mean[0], scale[0] = 0, 1
        z = ((x - mean) / scale).astype(np.float64)
        weight, edge = np.zeros(z.shape[1]), np.zeros((2, 2))
        m1 = m2 = np.zeros(len(weight) + 4)
        for step in range(1, STEPS + 1):
            g, h = cls.gradient(z, per_doc, label, weight, edge)
            grad = np.concatenate([g, h.ravel()])
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
            move = RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
            weight, edge = weight + move[:-4], edge + move[-4:].reshape(2, 2)
        return cls(mean, scale, weight, edge)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, most_lines: int = SAMPLE_LINES) -> LineField | None:
    """From the labelled documents that are not held out; held_out is an expression over doc_id. Draws
    the `sample` labels with the smallest hash of doc_id, and their documents as far as they have
    `most_lines` lines together."""
    drawn = labels.where("doc_id is not null and quality is not null").where(~held_out).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(it):
        for batch in it:
            data, off = views(batch.column("text"))
            for lo, hi in runs(off):
                x, _, per_doc = line_features(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                first = np.concatenate([[0], np.cumsum(per_doc)])
                yield pa.RecordBatch.from_arrays([batch.column("quality").slice(lo, hi - lo), pa.array([x[first[i] : first[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["quality", "lines"])

    text = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), text_hash(docs["text"]).alias("thash")).where(F.octet_length("text") <= SAMPLE_BYTES)
    lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1).cast("long")
    # at most `sample` labels are broadcast; one row of each is in one window, by hash
    each = text.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("thash", lines.alias("lines"))).alias("t"))
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = each.select("doc_id", "quality", "t.thash", F.sum("t.lines").over(so_far).alias("total")).where(F.col("total") <= most_lines).drop("total")
    # as many rows come to the driver, of `most_lines` lines together
    picked = text.join(F.broadcast(chosen), ["doc_id", "thash"]).groupBy("doc_id", "thash", "quality").agg(F.first("text").alias("text"))
    rows = picked.select("text", F.col("quality").cast("int").alias("quality")).mapInArrow(run, "quality int, lines binary").collect()
    label = np.array([min(1, max(0, r["quality"])) for r in rows], np.int64)
    if len(set(label.tolist())) < 2:
        return None
    width = len(line_features(np.empty(0, np.uint8), np.array([0, 0]))[0][0])
    parts = [np.frombuffer(r["lines"], np.float32).reshape(-1, width) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (label[i], rows[i]["lines"]))  # the same fit whatever the order of arrival
    return LineField.fit(np.concatenate([parts[i] for i in order]), np.array([len(parts[i]) for i in order]), label[order])


def score_batch(model: LineField | None, column: pa.Array) -> np.ndarray:
    data, off = views(column)
    if model is None or not len(column):
        return np.full(len(column), 0.5)
    return np.concatenate([model.scores(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]) for lo, hi in runs(off)])


def score(docs: DataFrame, model: LineField | None, held_out: Column) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(it):
        for batch in it:
            s = score_batch(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: LineField | None) -> DataFrame:
    """The rows of docs, all columns, that the model doesn't reject."""

    def run(it):
        for batch in it:
            text = batch.column(batch.schema.get_field_index("text"))
            if not pa.types.is_string(text.type) and not pa.types.is_large_string(text.type):
                text = text.cast(pa.string())
            yield batch.filter(pa.array(score_batch(model, text.fill_null("")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
