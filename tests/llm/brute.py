"""Plain versions of the operators over Python lists."""

from __future__ import annotations

import hashlib
import re

import xxhash

WHITE = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in WHITE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def op1(docs, n=13):
    """docs: (doc_id, text), ids distinct."""
    seen = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - n + 1):
            seen.setdefault(tuple(w[i : i + n]), set()).add(d)
    out = {}
    for d, t in docs:
        w = words(t)
        gone = {i + j for i in range(len(w) - n + 1) if min(seen[tuple(w[i : i + n])]) < d for j in range(n)}
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def substrings_rows(rows, n=13):
    """(doc_id, n_words, n_removed, kept) of every row, doc_ids repeated or null (as large as the largest long)."""
    least = {}
    rows = [(d, (1 << 63) - 1 if d is None else d, words(t)) for d, t in rows]
    for _, d, w in rows:
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            least[key] = min(d, least.get(key, d))
    out = []
    for shown, d, w in rows:
        gone = {j for i in range(len(w) - n + 1) if least[tuple(w[i : i + n])] < d for j in range(i, i + n)}
        out.append((shown, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def op3(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(WHITE.sub("", t or ""), []).append((-len(t or ""), d))
    return {d: (min(groups[WHITE.sub("", t or "")])[1], len(groups[WHITE.sub("", t or "")])) for d, t in docs}


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def op5(docs, items, n=10):
    split = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for name, t in items:
        w = split.findall(lower(t))
        if w:
            for i in range(max(1, len(w) - n + 1)):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = split.findall(lower(t))
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                names = windows.get(tuple(w[i : i + k]))
                if names:
                    hit |= set(range(i, i + k))
                    found |= names
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def simhash(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(prints, most=2):
    """prints: {doc_id: int} -> {doc_id: smallest doc_id reachable}."""
    ids, parent = sorted(prints), {d: d for d in prints}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def shingle_set(text, k=5):
    w = words(lower(text or ""))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near(docs, similarity=0.8):
    """Places in ``docs`` of the rows that stay: of each component under the Jaccard similarity the smallest doc_id."""
    sets = [shingle_set(t) for _, t in docs]
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                if old != new:
                    label = [new if x == old else x for x in label]
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0, i))
    best = {}
    for i in order:
        best.setdefault(label[i], i)
    return sorted(best.values())
