"""Plain versions of the operators, for small tables: lists of (doc_id, text)."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def covered(rows, units, size):
    """For each row which units lie in a window that a smaller document also has."""
    least = {}
    for doc, own in zip(rows, units):
        if doc[0] is not None:
            for i in range(len(own) - size + 1):
                key = tuple(own[i : i + size])
                least[key] = min(least.get(key, doc[0]), doc[0])
    out = []
    for doc, own in zip(rows, units):
        gone = [False] * len(own)
        if doc[0] is not None:
            for i in range(len(own) - size + 1):
                if least[tuple(own[i : i + size])] < doc[0]:
                    gone[i : i + size] = [True] * size
        out.append(gone)
    return out


def without_bytes(rows, size=50):
    units = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), own, gone in zip(rows, units, covered(rows, units, size)):
        spans = sum(b and not a for a, b in zip([False, *gone], gone))
        out.append((doc, len(own), sum(gone), spans, sha(bytes(x for x, g in zip(own, gone) if not g))))
    return sorted(out, key=str)


def without_words(rows, size=13):
    units = [words(t) for _, t in rows]
    return sorted(
        ((doc, len(own), sum(gone), sha(" ".join(x for x, g in zip(own, gone) if not g).encode())) for (doc, _), own, gone in zip(rows, units, covered(rows, units, size))),
        key=str,
    )


def bag(text):
    own = words(text)
    return collections.Counter(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))) if own else collections.Counter()


def classes(rows, similarity=0.8):
    """Classes of rows with a doc_id, by comparing every pair."""
    kept = [(d, bag(t)) for d, t in rows if d is not None]
    group = list(range(len(kept)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (a, x) in enumerate(kept):
        for j, (b, y) in enumerate(kept[:i]):
            both = sum((x & y).values())
            if a == b or (both and both >= similarity * sum((x | y).values()) - 1e-9):
                group[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(kept):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, least[top(i)]) for i, (d, _) in enumerate(kept))


def base_measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    own = words(text)
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    times = collections.Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)
