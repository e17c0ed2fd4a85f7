"""Language identification by rank-order profiles.

A profile is the list of the most frequent 1- to 3-letter-grams, by rank. A document is ranked alike and
compared with each language's profile by the out-of-place distance: the sum, over the document's
ranked grams, of how far each stands from its place in the profile, or the profile's length where
it has none.

Letters are code points of the Unicode categories L*, in lower case; every run of others counts as
one boundary, which grams of two and three hold like a letter. A gram is packed exactly, 21 bits a
letter.

Profiles are counted over all rows given to fit(). Defined cases: a null text, or one without letters,
is `und` with score 0; without profiles every text is; rows with null languages teach nothing; ties go
to the language first in the alphabet; repeated rows give repeated results.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grams in a profile.
PROFILE = 400
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: its lower-case letter, or 0."""
    if not _TABLE:
        table = np.zeros(0x110000, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a text in ascending order, and their counts."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[0], codes, [0]])
    keep = (codes > 0) | np.concatenate([[True], codes[:-1] > 0])  # one boundary for a run of others
    codes = codes[keep]
    if len(codes) < 3 and not (codes > 0).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    two = codes[:-1] << 21 | codes[1:]
    three = two[:-1] << 21 | codes[2:]
    # bit 42 marks two letters and the sign three, so that lengths never meet
    one = codes[codes > 0]
    return np.unique(np.concatenate([one, two | 1 << 42, three ^ np.int64(-(1 << 63))]), return_counts=True)


def ranked(gram: np.ndarray, count: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent, ties by gram."""
    if len(gram) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        keep = count >= least
        gram, count = gram[keep], count[keep]
    return gram[np.lexsort((gram, -count))[:size]]


def fit(docs: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles by language from the columns text and lang. The driver gets `size` grams a language."""

    def run(it):
        # by language: sorted grams with counts, merged whenever many are waiting
        waiting: dict[str, list] = {}

        def merge(lang):
            g = np.concatenate([x[0] for x in waiting[lang]])
            c = np.concatenate([x[1] for x in waiting[lang]])
            g, at = np.unique(g, return_inverse=True)
            waiting[lang] = [(g, np.bincount(at, c).astype(np.int64))]

        held: dict[str, int] = {}
        for batch in it:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                g, c = grams(text.as_py())
                if len(g):
                    waiting.setdefault(lang, []).append((g, c))
                    held[lang] = held.get(lang, 0) + len(g)
                    if held[lang] > 1_000_000:
                        merge(lang)
                        held[lang] = len(waiting[lang][0][0]) // 2
        for lang in list(waiting):
            merge(lang)
            g, c = waiting.pop(lang)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g, pa.int64()), pa.array(c, pa.int64())], ["lang", "gram", "n"])

    counted = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.known = np.unique(np.concatenate([np.empty(0, np.int64), *profiles.values()]))
        self.rank = np.full((len(self.known) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.rank[np.searchsorted(self.known, profiles[name]), k] = np.arange(len(profiles[name]))

    def distances(self, top: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, top)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != top)] = len(self.known)
        rank = self.rank[at]
        return np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top))[:, None])).sum(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.names:
            return "und", 0.0
        gram, count = grams(text)
        if not len(gram):
            return "und", 0.0
        d = self.distances(ranked(gram, count, self.size))
        best = int(d.argmin())
        rest = np.delete(d, best)
        return self.names[best], float(1 - d[best] / rest.min()) if len(rest) and rest.min() else 1.0


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], held_out: Column, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred and score: how much nearer the best profile is than the second."""
    model = Profiles(profiles, size)

    def run(it):
        for batch in it:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
