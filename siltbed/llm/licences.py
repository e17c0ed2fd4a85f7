"""Licence scans by a positional rare-token index.

Templates are licence texts and notices with mandatory key phrases. The index has, for every word of
theirs, its postings (template, offset). Two passes over the corpus:

1. document frequencies, over all documents, of the templates' words: rare words have a high IDF;
2. each file's words are read once. The licence words that it holds say which templates it may hold
   at all: at most the share 1 - COVERAGE of a template's places may be missing. For each of those the
   file's own highest-IDF licence words are looked up, as many as may be out of place and AGREE more;
   an occurrence at p of a word with offset r proposes the start p - r, and starts that AGREE postings
   share are verified: the words in their places, and every key phrase in the window.

In long templates a word is in place up to `shift` words away (one for each 16 words, MOST_SHIFT at
most), so a name put in between doesn't lose the rest; key phrases may stand as far outside. Base
phrases allow no gap and no missing word. No start that fulfils this is lost: tests hold labels and
scores against trying all starts.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Defined cases: null and empty
texts have no words and score 0; repeated rows give repeated results; an empty table gives no rows;
other columns are not read. The index is as large as the templates, whatever the corpus.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import Polynomial, document_batches, lowered, nullable_ids, runs, text_columns, words

WORD = np.zeros(256, bool)
WORD[48:58] = True
WORD[97:123] = True
WORD[128:] = True

#: The share of a template's words that must be in place, and the postings that must agree on a start.
COVERAGE, AGREE = 0.85, 2
MOST_SHIFT = 4
#: Files whose licence words are compared with all templates at once.
FILES = 2048


def split(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key_phrases: tuple[str, ...] = ()
    base: bool = False


#: The phrases that every scan reports in all their places.
BASE = (
    Template("cc-by", "cc by", base=True),
    Template("gpl", "general public license", base=True),
    Template("reserved", "all rights reserved", base=True),
)

#: Licence texts and notices in the wording that their licences have or recommend.
_NO_WARRANTY = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", ("apache license", "warranties or conditions of any kind")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "without restriction")),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", ("to deal in the software without restriction", "substantial portions of the software")),
    Template("gpl-3.0", "gnu general public license version 3", ("version 3",)),
    Template("gpl-2.0", "gnu general public license version 2", ("version 2",)),
    Template("gpl-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_NO_WARRANTY}. See the GNU General Public License for more details.", ("gnu general public license", "version 3")),
    Template("gpl-2.0", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_NO_WARRANTY}. See the GNU General Public License for more details.", ("gnu general public license", "version 2")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("lgpl", f"This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_NO_WARRANTY}. See the GNU Lesser General Public License for more details.", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("agpl", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; {_NO_WARRANTY}. See the GNU Affero General Public License for more details.", ("affero general public license",)),
    Template("cc-by-nc", "cc by nc", ("cc by nc",)),
    Template("cc-by-sa", "cc by sa", ("cc by sa",)),
    Template("cc-by-nd", "cc by nd", ("cc by nd",)),
    Template("cc-by", "creative commons attribution", ("creative commons attribution",)),
    Template("cc0", "cc0 1 0 universal", ("cc0",)),
    Template("cc0", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.", ("to the extent possible under law", "waived all copyright")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    Template("bsd", "licensed under the bsd license", ("bsd license",)),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""", ("redistributions of source code", "redistributions in binary form")),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla public license", "source code form")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "hereby granted")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""", ("with or without fee", "the author disclaims all warranties")),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ("permission is granted to anyone", "redistribute it freely")),
    Template("bsl-1.0", "Boost Software License, Version 1.0", ("boost software license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered software", "public domain")),
)


@dataclass
class Index:
    """The templates over word numbers."""

    templates: tuple[Template, ...]
    vocabulary: list[str] = field(init=False)
    hashes: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)

    def __post_init__(self):
        self.vocabulary = sorted({w for t in self.templates for p in (t.text, *t.key_phrases) for w in split(p)})
        raw = np.frombuffer("".join(self.vocabulary).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.vocabulary])
        h = Polynomial(raw).ranges(np.concatenate([[0], ends[:-1]]), ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.want = [self.numbers(t.text) for t in self.templates]
        self.phrases = [[self.numbers(p) for p in t.key_phrases] for t in self.templates]
        self.size = np.array([len(w) for w in self.want])
        self.shift = [0 if t.base else min(MOST_SHIFT, len(w) // 16) for t, w in zip(self.templates, self.want)]
        self.spare = np.array([0 if t.base else int((1 - COVERAGE) * len(w) + 1e-9) for t, w in zip(self.templates, self.want)])
        # postings by word: how many places of each template it has
        self.places = np.zeros((len(self.vocabulary), len(self.templates)), np.float32)
        for k, w in enumerate(self.want):
            np.add.at(self.places, (w, k), 1)

    def numbers(self, phrase: str) -> np.ndarray:
        at = {w: i for i, w in enumerate(self.vocabulary)}
        return np.array([at[w] for w in split(phrase)], np.int64)

    def weigh(self, idf: np.ndarray) -> None:
        """Puts each template's places in order of IDF, highest first."""
        self.idf = idf
        self.rarest = [np.argsort(-idf[w], kind="stable") for w in self.want]

    def read(self, data: np.ndarray, off: np.ndarray):
        """By word of the documents: number in the vocabulary or -1; its document; each document's
        first word."""
        low = lowered(data)
        start, end = words(low, off, WORD)
        first = np.searchsorted(start, off[:-1])
        if not len(start):
            return np.empty(0, np.int64), first, np.zeros(len(off) - 1, np.int64)
        h = Polynomial(low).ranges(start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        number = np.where(self.hashes[at] == h, self.order[at], -1)
        return number, first, np.diff(np.concatenate([first, [len(start)]]))

    def found(self, number: np.ndarray, first: np.ndarray, n_words: np.ndarray):
        """(file, template, starts, score) of the templates that stand in the files, starts in words of
        the file."""
        v = len(self.vocabulary)
        at = np.flatnonzero(number >= 0)
        file = np.searchsorted(first, at, "right") - 1
        key = file * v + number[at]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        held, edge = np.unique(key, return_index=True)  # file and word; its occurrences
        edge = np.append(edge, len(key))
        files = np.unique(held // v)
        for lo in range(0, len(files), FILES):
            some = files[lo : lo + FILES]
            a, b = np.searchsorted(held, [some[0] * v, (some[-1] + 1) * v])
            has = np.zeros((len(some), v), np.float32)
            has[np.searchsorted(some, held[a:b] // v), held[a:b] % v] = 1
            absent = self.size - np.rint(has @ self.places).astype(np.int64)
            for row, t in zip(*np.nonzero((absent <= self.spare) & (n_words[some][:, None] >= self.size))):
                d, want = int(some[row]), self.want[t]
                rare = self.rarest[t][has[row, want[self.rarest[t]]] > 0][: self.spare[t] - absent[row, t] + min(AGREE, len(want))]
                votes = []
                for r in rare.tolist():
                    k = np.searchsorted(held, d * v + want[r])
                    start = at[edge[k] : edge[k + 1]] - first[d] - r
                    votes.append(start if not self.shift[t] else np.unique(start[:, None] + np.arange(-self.shift[t], self.shift[t] + 1)))
                start, agree = np.unique(np.concatenate(votes), return_counts=True)
                start = start[(agree >= min(AGREE, len(want))) & (start >= 0) & (start + len(want) <= n_words[d])]
                if len(start):
                    good, score = self.verified(int(t), number[first[d] : first[d] + n_words[d]], start)
                    if len(good):
                        yield d, int(t), good, score

    def verified(self, t: int, file: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the starts those at which the template stands, and the best IDF-weighted share in place."""
        want, s = self.want[t], self.shift[t]
        n = len(want)
        best, good = 0.0, []
        padded = np.concatenate([np.full(s, -2), file, np.full(s, -2)])
        for lo in range(0, len(start), 4096):
            some = start[lo : lo + 4096]
            window = padded[some[:, None] + np.arange(n + 2 * s)]  # from s words before the start
            hit = np.zeros((len(some), n), bool)
            for e in range(2 * s + 1):
                hit |= window[:, e : e + n] == want
            ok = hit.sum(1) >= n - self.spare[t]
            for p in self.phrases[t]:
                m, there = len(p), np.zeros(len(some), bool)
                for o in range(n + 2 * s - m + 1):
                    there |= (window[:, o : o + m] == p).all(1)
                ok &= there
            if ok.any():
                good.append(some[ok])
                best = max(best, float((hit[ok] @ self.idf[want]).max() / self.idf[want].sum()))
        return np.concatenate(good) if good else np.empty(0, np.int64), min(1.0, best)


def frequencies(docs: DataFrame, index: Index) -> tuple[int, dict[int, int]]:
    """Documents in all, and by vocabulary word the documents that hold it."""

    def run(it):
        total = np.zeros(len(index.vocabulary) + 1, np.int64)
        for _, _, _, data, off in document_batches(it):
            total[-1] += len(off) - 1
            for lo, hi in runs(off):
                o = off[lo : hi + 1] - off[lo]
                number, first, _ = index.read(data[off[lo] : off[hi]], o)
                known = np.flatnonzero(number >= 0)
                doc = np.searchsorted(first, known, "right") - 1
                pair = np.unique(doc * len(index.vocabulary) + number[known])
                total[:-1] += np.bincount(pair % len(index.vocabulary), minlength=len(index.vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), pa.array(total, pa.int64())], ["word", "n"])

    rows = text_columns(docs).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # as many rows as the vocabulary has words
    counts = {r["word"]: r["n"] for r in rows}
    return counts.pop(len(index.vocabulary), 0), counts


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base (places of base phrases), first_word and last_word
    (smallest and largest start of them), base_labels, labels and score, the IDF-weighted share of the
    words in their places, of the best template."""
    index = Index(templates)
    n_docs, counts = frequencies(docs, index)
    index.weigh(np.array([math.log((n_docs + 1) / (counts.get(i, 0) + 1)) + 1 for i in range(len(index.vocabulary))]))

    def run(it):
        for ids, null, _, data, off in document_batches(it):
            out = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for lo, hi in runs(off):
                number, first, n_words = index.read(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                k = hi - lo
                n_base, lowest, highest, score = np.zeros(k, np.int64), np.full(k, len(number) + 1), np.full(k, -1), np.zeros(k)
                base, labels = [set() for _ in range(k)], [set() for _ in range(k)]
                for d, t, start, share in index.found(number, first, n_words):
                    score[d] = max(score[d], share)
                    labels[d].add(templates[t].label)
                    if templates[t].base:
                        base[d].add(templates[t].label)
                        n_base[d] += len(start)
                        lowest[d], highest[d] = min(lowest[d], start[0]), max(highest[d], start[-1])
                out["n_words"].append(n_words)
                out["n_base"].append(n_base)
                out["first_word"].append(lowest)
                out["last_word"].append(highest)
                out["score"].append(score)
                out["base_labels"] += [",".join(sorted(x)) for x in base]
                out["labels"] += [",".join(sorted(x)) for x in labels]
            n_base = np.concatenate(out["n_base"])
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [nullable_ids(ids, null), pa.array(np.concatenate(out["n_words"]), pa.int64()), pa.array(n_base, pa.int64()), pa.array(np.concatenate(out["first_word"]), pa.int64(), mask=none), pa.array(np.concatenate(out["last_word"]), pa.int64(), mask=none), pa.array(out["base_labels"]), pa.array(out["labels"]), pa.array(np.concatenate(out["score"]), pa.float64())],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return text_columns(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
