"""Plain versions of what the corpus operators compute, one document or pair at a time."""

import math
import re

LOW = str.maketrans({c: c + 32 for c in range(65, 91)})


def word_sets(texts, n):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def groups(names, sets, percent):
    """By row the smallest name that links lead to."""
    low = list(range(len(names)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                low[find(i)] = find(j)
    best = {}
    for i, name in enumerate(names):
        best[find(i)] = min(best.get(find(i), name), name)
    return [best[find(i)] for i in range(len(names))]


def removed_bytes(docs, length):
    """docs: (name, bytes) in order. By name a bytearray of 1 for each byte that goes."""
    seen, out = set(), {}
    for name, b in docs:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if b[k : k + length] in seen:
                gone[k : k + length] = b"\1" * length
            else:
                seen.add(b[k : k + length])
        out[name] = gone
    return out


def smith_waterman(item, passage, gain, gap):
    """The best local score: a match of word w earns gain[w], mismatches and gaps cost gap."""
    best, before = 0.0, [0.0] * (len(passage) + 1)
    for w in item:
        row = [0.0]
        for j, v in enumerate(passage, 1):
            row.append(max(0.0, before[j - 1] + (gain[w] if v == w else -gap), before[j] - gap, row[-1] - gap))
        best, before = max(best, *row), row
    return best


def line_dedup(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text). The texts without the lines that go."""
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOW)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if gone.get(key(x), i) == i)) for i, t in rows]


def licences(text, templates, idf, coverage, most_shift):
    """(labels, base labels, starts of base phrases, best score), every start tried."""
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.translate(LOW))
    w, labels, base, starts, best = cut(text or ""), set(), set(), [], 0.0
    for t in templates:
        want = cut(t.text)
        n = len(want)
        s = 0 if t.base else min(most_shift, n // 16)
        spare = 0 if t.base else int((1 - coverage) * n + 1e-9)
        for at in range(len(w) - n + 1):
            window = lambda lo, hi: w[max(0, lo) : max(0, hi)]
            hit = [want[i] in window(at + i - s, at + i + s + 1) for i in range(n)]
            around = window(at - s, at + n + s)
            phrases = all(any(around[k : k + len(cut(p))] == cut(p) for k in range(len(around))) for p in t.key_phrases)
            if sum(hit) >= n - spare and phrases:
                labels.add(t.label)
                best = max(best, sum(idf[x] for x, h in zip(want, hit) if h) / sum(idf[x] for x in want))
                if t.base:
                    base.add(t.label)
                    starts.append(at)
    return labels, base, sorted(starts), best


def entropy_step(window):
    counts = {}
    for b in window:
        counts[b] = counts.get(b, 0) + 1
    e = -sum(c / len(window) * math.log2(c / len(window)) for c in counts.values())
    return round(e * 1000 / math.log2(len(window)))
