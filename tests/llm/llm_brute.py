"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def near(rows, size, percent=80):
    """``{doc_id: (n_shingles, component_id)}`` by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        words = WORD.findall(ascii_lower(text or ""))
        grams = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        sets[doc_id] = grams or ({tuple(words)} if words else set())
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(s), root(k)) for k, s in sets.items()}


def repeats(texts, window):
    """``[(n_words, n_removed, sha256 of the kept words)]`` in the order of the texts."""
    split = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def edit_distance_inside(item, text):
    """Fewest edits between the item and any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        diagonal, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (a != b))
    return min(row)


def quality(text):
    """word count, word characters, symbols, repeated lines, words in repeated windows"""
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {
        j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)
    }
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def boilerplate(rows, sites):
    """``(text, site)`` rows -> the texts without lines that ``sites`` sites share."""
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    held = defaultdict(set)
    for text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(strip) and site is not None:
                held[line.strip(strip)].add(site)
    bad = {line for line, where in held.items() if len(where) >= sites}
    return [
        None if text is None else "\n".join(x for x in text.split("\n") if x.strip(strip) not in bad)
        for text, _ in rows
    ]
