"""Brute-force versions of the operators, written from the contracts in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def near(rows, k=3):
    """{(doc_id, fingerprint): component} of (doc_id, text) rows."""
    prints = [fingerprint(t, k) for _, t in rows]
    roots = components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (doc_id, _), r in zip(rows, roots, strict=True):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(d, f"{p:016x}", least.get(r)) for (d, _), p, r in zip(rows, prints, roots, strict=True)]


def near_copies(rows, k=5, share=0.8):
    """The smallest doc_id of the group of each (doc_id, text) row; groups are closed over pairs with common shingles."""
    sets = []
    for _, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    roots = components(sets, lambda a, b: a == b or len(a & b) >= share * len(a | b))
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [least[r] for r in roots]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


BASE = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)


def secrets(text):
    """(start, order of kind, kind, end) of the base spans."""
    out = []
    for no, (kind, pattern, group, least) in enumerate(BASE):
        for m in pattern.finditer(text or ""):
            if len(m[group]) >= least:
                out.append((m.start(), no, kind, m.end()))
    return sorted(out)


def base_digest(text):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in secrets(text)).encode()).hexdigest()
