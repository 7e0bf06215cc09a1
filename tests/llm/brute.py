"""Plain single-process versions of the operators, to test against."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

SPACES = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(f"[{SPACES}]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def shingle_set(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def united(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_components(docs, k, percent):
    """docs: {id: text} -> {id: (n, component)}"""
    sets = {i: shingle_set(t, k) for i, t in docs.items()}
    where = {}
    for i, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(i)
    seen = {}
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b:
                    seen[a, b] = seen.get((a, b), 0) + 1
    links = [(a, b) for (a, b), o in seen.items() if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o)]
    root = united(sets, links)
    return {i: (len(sets[i]), root[i]) for i in sets}


def secrets(text):
    text, spans = text or "", []
    kinds = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    for order, (kind, pattern) in enumerate(kinds.items()):
        for m in pattern.finditer(text):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= {"access": 20, "hex": 24}[kind]:
                spans.append((m.start(), order, kind, m.end()))
    spans.sort()
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest(), [sum(k == x for _, _, k, _ in spans) for x in kinds]


def repeated_bytes(docs, length=50):
    """docs: {id: text} -> {id: (n_bytes, n_removed, n_spans, sha256 of the rest)}"""
    data = {i: (t or "").encode() for i, t in docs.items()}
    first = {}
    for i in sorted(data):
        for s in range(len(data[i]) - length + 1):
            first.setdefault(data[i][s : s + length], i)
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d) + 1, bool)
        for s in range(len(d) - length + 1):
            if first[d[s : s + length]] < i:
                gone[s : s + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        rest = bytes(np.frombuffer(d, np.uint8)[~gone[:-1]])
        out[i] = (len(d), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest())
    return out


def near_vectors(vectors, cosine):
    """vectors: {id: list or None} -> {id: (n_links, component)}"""
    good = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= cosine]
    root = united(vectors, links)
    n = {i: 0 for i in vectors}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], root[i]) for i in vectors}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def later_lines(docs, percent=80):
    """docs: {id: text} -> {id: (n_lines, [numbers of lines that match an earlier one])}"""
    sets, order = [], []
    for i in sorted(docs):
        for k, line in enumerate(docs[i].split("\n") if docs[i] else []):
            if s := frozenset(words(line)):
                order.append((i, k))
                sets.append(s)
    where, gone = {}, {i: [] for i in docs}
    for x, s in enumerate(sets):
        seen = {}
        for w in s:
            for y in where.get(w, ()):
                seen[y] = seen.get(y, 0) + 1
        if any(100 * o >= percent * (len(s) + len(sets[y]) - o) for y, o in seen.items()):
            gone[order[x][0]].append(order[x][1])
        for w in s:
            where.setdefault(w, []).append(x)
    return {i: (len(docs[i].split("\n")) if docs[i] else 0, gone[i]) for i in docs}
