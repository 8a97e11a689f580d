"""Plain versions of the operators, row by row, that the tests compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

SPACED = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def digits(m: re.Match) -> str:
    return re.sub("[^0-9]", "", m[0])


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)
SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
)


def spans(text: str | None, kinds, by_start: bool) -> tuple[str, list[int]]:
    found = [(k, m.start(), m.end(), n) for n, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m)]
    if by_start:
        found.sort(key=lambda x: (x[1], x[3]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found), [sum(x[0] == k for x in found) for k, _, _ in kinds]


def contamination(docs, items, width=10):
    windows = defaultdict(set)
    for i, text in items:
        w = re.findall(PLAIN, low(text or ""))
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k : k + width])].add("" if i is None else str(i))
    sizes = {len(k) for k in windows}
    for i, text in docs:
        w = re.findall(PLAIN, low(text or ""))
        hit, of = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    of |= own
        yield i, len(w), len(hit), len(of), sha(",".join(sorted(of))), bool(hit)


def shingles(text: str | None) -> frozenset:
    w = re.findall(SPACED, low(text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def groups(docs, similar=75):
    """n_shingles and component of each of (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * 100 >= similar * max(len(x), len(y)) and 100 * len(x & y) >= similar * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least.get(find(k))) for k, (i, s) in enumerate(sets)]


def _later(docs, places):
    """Places (start) of each document whose value also starts earlier; null ids last."""
    first = {}
    rank = lambda i: (i is None, i or 0)
    for i, t in docs:
        for start, value in places(t or ""):
            key = (rank(i), start)
            first[value] = min(first.get(value, key), key)
    return [[s for s, v in places(t or "") if first[v] < (rank(i), s)] for i, t in docs]


def word_dedup(docs, width=20):
    words = lambda t: re.findall(SPACED, t)
    runs = lambda w: [(k, tuple(w[k : k + width])) for k in range(len(w) - width + 1)]
    later = _later(docs, lambda t: runs(words(t)))
    for (i, t), starts in zip(docs, later, strict=True):
        w = words(t or "")
        gone = {k for s in starts for k in range(s, s + width)}
        yield i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))


def byte_dedup(docs, least=100):
    runs = lambda raw: [(k, raw[k : k + least]) for k in range(len(raw) - least + 1)]
    later = _later(docs, lambda t: runs(t.encode()))
    for (i, t), starts in zip(docs, later, strict=True):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in starts:
            gone[s : s + least] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        yield i, len(raw), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


def quality(text: str | None):
    text = text or ""
    w = re.findall(SPACED, text)
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(SPACED, x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)
