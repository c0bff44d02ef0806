"""Plain-Python versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(BASE[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return sorted(out)


def pii(text: str | None) -> tuple:
    s = base_spans(text or "")
    n = tuple(sum(x[2] == k for x in s) for k in KINDS)
    return (*n, hashlib.sha256(",".join(f"{k}:{a}:{e}" for a, _, k, e in s).encode()).hexdigest())


def shingles(text: str | None, n: int = 5) -> set:
    w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts: dict) -> dict:
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    index: dict = {}
    for k in keys:
        met = set()
        for s in sets[k]:
            met |= set(index.get(s, ()))
            index.setdefault(s, []).append(k)
        for o in met:
            both = len(sets[k] & sets[o])
            if 100 * both >= 80 * (len(sets[k]) + len(sets[o]) - both):
                a, b = sorted((find(k), find(o)))
                root[b] = a
    return {k: (len(sets[k]), find(k)) for k in keys}


def repeated_bytes(texts: dict, size: int = 200) -> dict:
    raw = {k: (t or "").encode() for k, t in texts.items()}
    seen: dict = {}
    for b in raw.values():
        for i in range(len(b) - size + 1):
            h = b[i : i + size]
            seen[h] = seen.get(h, 0) + 1
    out = {}
    for k, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[k] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
