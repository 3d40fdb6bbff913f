"""Plain versions of the operators, over lists of ``(doc_id, text)``."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().lower().split()


def exact_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i))
    out = {}
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            out[i] = (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def shingle_set(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard_components(rows, n, percent):
    sets = {i: shingle_set(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def removed_bytes(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if (window := data[s : s + length]) in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen.add(window)
        spans = sum(gone[x] and (x == 0 or not gone[x - 1]) for x in range(len(data)))
        out[i] = (len(data), sum(gone), spans, bytes(c for c, g in zip(data, gone) if not g))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def lines_left(rows, limit, least):
    seen, out = [], {}
    for i, t in sorted(rows):
        left = []
        for line in (t or "").split("\n"):
            gone = False
            if len(line) >= least:
                gone = any(abs(len(line) - len(s)) <= limit and edits(line, s) <= limit for s in seen)
                seen.append(line)
            if not gone:
                left.append(line)
        out[i] = "\n".join(left)
    return out


_BASE = {
    "assign": (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 0, 18),
    "hex": (r"([0-9a-f]+)", 0, 16),
}


def base_spans(text):
    spans = []
    for order, (kind, (pattern, flags, least)) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text or "", flags):
            if len(m[1]) >= least:
                spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(spans))


def base_scores(rows, modulo=10):
    held = {i: zlib.crc32(str(i).encode()) % modulo == 0 for i, _ in rows}
    tokens = {i: [*words(t), None] for i, t in rows}
    count = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(count.values()), len(count)
    return {
        i: (held[i], len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        for i, t in tokens.items()
    }
