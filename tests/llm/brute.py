"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np


def components(nodes, edges):
    """The smallest node reachable from each node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return set()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def jaccard(rows, n=4, num=85, den=100):
    """{id: (size, component)} of (id, text) rows, comparing all pairs that share a shingle."""
    sets = {d: shingles(t, n) for d, t in rows}
    post = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            post[x].append(d)
    edges, common = [], defaultdict(int)
    for ds in post.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if den * c >= num * (len(sets[a]) + len(sets[b]) - c):
            edges.append((a, b))
    comp = components(sets, edges)
    return {d: (len(s), comp[d]) for d, s in sets.items()}


def repeated_bytes(rows, length=100):
    """{id: (n_bytes, n_removed, n_spans, sha of the rest)} of (id, text) rows in order of id."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                gone[i:i + length] = True
            else:
                seen.add(s)
        mask = gone[:len(b)]
        spans = int(np.sum(np.diff(gone.astype(np.int8), prepend=0) == 1))
        rest = bytes(x for x, g in zip(b, mask) if not g)
        out[d] = (len(b), int(mask.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def near(a, b):
    """Whether two texts are within one edit."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] or a[i + 1:] == b[i:] or a[i:] == b[i + 1:]


def dedup_lines(rows, min_chars):
    """{id: text} of (id, text) rows in order of id, comparing each line with all earlier ones."""
    seen, same, out = [], set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out[d] = None
            continue
        kept = []
        for line in t.split("\n"):
            if not line.strip(" \t\n\v\f\r"):
                kept.append(line)
                continue
            if line not in same and not (len(line) >= min_chars and any(near(line, s) for s in seen)):
                kept.append(line)
            same.add(line)
            if len(line) >= min_chars:
                seen.append(line)
        out[d] = "\n".join(kept)
    return out


def cosine_links(rows, least):
    """{id: (n_links, component)} of (id, vector, label) rows."""
    ok = [(i, np.array(v, np.float64), lab) for i, v, lab in rows
          if lab is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
          and any(x != 0 for x in v)]
    n, edges = {r[0]: 0 for r in rows}, []
    for k, (i, v, lab) in enumerate(ok):
        for j, w, other in ok[k + 1:]:
            if lab == other and len(v) == len(w) and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= least:
                n[i] += 1
                n[j] += 1
                edges.append((i, j))
    comp = components(n, edges)
    return {i: (n[i], comp[i]) for i in n}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def passages(rows, window=20):
    """[(id, words, removed, kept)] of (id, text) rows, in order of id (none first), then of the input."""
    seen, out = set(), []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    for i in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            if key in seen:
                gone[a:a + window] = [True] * window
            seen.add(key)
        out.append((rows[i][0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def codes(rows, factor=1024, entries=256, rounds=4):
    """[(id, code, error, label error, sha)] of (id, vector, label) rows of one length."""
    rows = [r for r in rows if usable(r[1])]
    x = np.floor(factor * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].tolist()))[:entries]
    code, error, final = [], np.zeros(len(rows), np.int64), []
    for cols in np.array_split(np.arange(x.shape[1]), 4):
        part, book = x[:, cols], x[first][:, cols].copy()
        for turn in range(rounds + 1):
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            to = d.argmin(1)
            if turn < rounds:
                for k in set(to.tolist()):
                    book[k] = part[to == k].sum(0) // (to == k).sum()
        code.append(to)
        error += d[np.arange(len(to)), to]
        final += book.ravel().tolist()
    sha = hashlib.sha256(",".join(map(str, final)).encode()).hexdigest()
    by = defaultdict(int)
    for r, e in zip(rows, error.tolist()):
        by[r[2]] += e
    return [(r[0], "".join(f"{c[i]:02x}" for c in code), int(error[i]), by[r[2]], sha) for i, r in enumerate(rows)]


def whitened(rows, factor=256, count=4):
    """(n, deviations, components of each row, explained) of (id, vector) rows of one length."""
    x = np.floor(factor * np.array([r[1] for r in rows if usable(r[1])], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    z = fit - total / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = e[::-1], v[:, ::-1]
    dev = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return n, dev, (x - total / n) @ v[:, :count] / np.sqrt(e[:count]), e[:count] / e.sum()
