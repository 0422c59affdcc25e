"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re


def pii(text: str) -> dict:
    out, counts = [], {}
    luhn = lambda d: sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    for kind, (pattern, good) in kinds.items():
        found = [(m.start(), m.end()) for m in re.finditer(pattern, text) if good(m[0])]
        counts["n_" + kind] = len(found)
        out += [f"{kind}:{a}:{b}" for a, b in found]
    return counts | {"base": out, "base_sha256": hashlib.sha256(",".join(out).encode()).hexdigest()}


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, k: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def closure(ids: list, links: list) -> dict:
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_duplicates(rows: list, percent: int = 85) -> dict:
    sets = {i: shingles(t) for i, t in rows}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    links, ids = [], sorted(sets)
    for i in ids:
        for j in {j for x in sets[i] for j in where[x] if j > i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
    return closure(ids, links)


def repeats(rows: list, n: int = 50) -> dict:
    """rows: (doc_id, bytes) -> doc_id: (n_removed, n_spans, kept bytes)."""
    first = {}
    for d, t in rows:
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < d:
                gone[i : i + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g))
    return out
