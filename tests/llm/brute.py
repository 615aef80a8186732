"""Plain Python statements of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(A_TO_Z)


def shingles(text, words=4):
    w = SPACE_WORD.findall(low(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1)))


def near_duplicates(rows, words=4):
    """{doc_id: (n_shingles, component_id, kept)} by comparing all texts that share a shingle."""
    sets = {i: shingles(t, words) for i, t in rows}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen = set()
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                pair = (ids[b], ids[a])
                if pair in seen:
                    continue
                seen.add(pair)
                x, y = sets[pair[0]], sets[pair[1]]
                if 100 * len(x & y) >= 80 * len(x | y):
                    p, q = sorted((find(pair[0]), find(pair[1])))
                    root[q] = p
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def contamination(docs, items):
    """{doc_id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    windows = {}
    for item, text in items:
        w = ALNUM_WORD.findall(low(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    lengths = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        w = ALNUM_WORD.findall(low(text))
        hit, names = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i:i + n]))
                if found:
                    hit.update(range(i, i + n))
                    names |= found
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(names), digest, bool(hit))
    return out


def crc(text):
    return zlib.crc32((text or "").encode())


def runs(words, shortest=24, periods=3):
    """(start, length, period) of every run, by trying every period at every word."""
    out, seen = [], set()
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, periods * q) and (i, length) not in seen:    # else a shorter period has it
                seen.add((i, length))
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_digest(doc_id, text, planted=True):
    """The row of op12 for one document."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if planted and doc_id is not None and words:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found, drop = runs(words), set()
    for start, length, period in found:
        drop.update(range(start + period, start + length))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
