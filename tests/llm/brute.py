"""Plain versions of the operators, to hold their results against. Each works on one table in memory."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def targets(sizes):
    """sizes: source -> words. Caps one source at a time until no target is above three times its size."""
    order = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in over}


def spans(text):
    text = text or ""
    kinds = [
        (
            "assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
            2, 12
        ),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16)
    ]
    out = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(kinds) for m in p.finditer(text) if len(m[g]) >= least]
    return [(name, a, b) for a, _, b, name in sorted(out)]


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fingerprint(text, size=3):
    w = WORD.findall(low(text))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    counts = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def components(fps, radius=2):
    """fps: one per row. The row numbers of each row's component, least first."""
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[root(i)].append(i)
    return [groups[root(i)] for i in range(len(fps))]


def unigram(rows):
    """rows: (doc_id, text). n_tokens, n_known, N and the base score of each."""
    from math import log10

    tokens = [[*WORD.findall(low(t)), None] for _, t in rows]
    c = Counter()
    for (d, _), own in zip(rows, tokens, strict=True):
        if zlib.crc32(str(d).encode()) % 10 or d is None:
            c.update(own)
    n, v = sum(c.values()), len(c)
    return [(len(own), sum(c[x] > 0 for x in own), n, sum(log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)) for own in tokens]


class Ppm:
    """A trie of counts as nested dictionaries; symbol exclusion with sets."""

    def __init__(self, texts, order):
        self.order, self.counts = order, defaultdict(Counter)
        for t in texts:
            b = b"\xfe" * order + low(t).encode() + b"\xff"
            for i in range(order, len(b)):
                for k in range(order + 1):
                    self.counts[b[i - k : i]][b[i]] += 1

    def score(self, text):
        from math import log10

        b, total = b"\xfe" * self.order + low(text).encode() + b"\xff", 0.0
        for i in range(self.order, len(b)):
            ruled, p = set(), 1.0
            for k in range(self.order, -1, -1):
                here = {s: n for s, n in self.counts.get(b[i - k : i], {}).items() if s not in ruled}
                if not here:
                    continue
                whole = sum(here.values()) + len(here)
                if b[i] in here:
                    p *= here[b[i]] / whole
                    break
                p *= len(here) / whole
                ruled |= set(here)
            else:
                p *= 1 / (257 - len(ruled))
            total += log10(p)
        return total
