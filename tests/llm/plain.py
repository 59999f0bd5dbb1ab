"""Brute-force versions of the operators' contracts, a text at a time."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            s = m.group()
            digits = sum(c in "0123456789" for c in s)
            if kind == "ip" and any(int(p) > 255 for p in s.split(".")) or kind == "card" and not (14 <= digits <= 19 and luhn(s)) or kind == "phone" and not 10 <= digits <= 15:
                continue
            found.append((m.start(), k, kind, m.end()))
    return [(a, kind, b) for a, _, kind, b in sorted(found)]


def pii(text: str | None) -> tuple:
    spans = base_spans(text or "")
    count = Counter(k for _, k, _ in spans)
    return (*(count[k] for k in BASE), sha(",".join(f"{k}:{a}:{b}" for a, k, b in spans)))


def quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def contamination(text: str | None, items: dict) -> tuple:
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    doc, hit, found = words(text), set(), set()
    for name, item in items.items():
        w = words(item)
        size = min(13, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for j in range(len(doc) - size + 1) if size else ():
            if doc[j] in w and tuple(doc[j : j + size]) in windows:
                hit |= set(range(j, j + size))
                found.add(str(name))
    return len(doc), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(doc)


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: dict) -> dict:
    """doc_id: smallest doc_id reachable over fingerprints at two bits or fewer."""
    root = {d: d for d in prints}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in ids}


def similar(texts, percent=80):
    """doc_id: smallest doc_id reachable over five-word shingle sets that are as similar."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in texts.items() if (w := (t or "").lower().split())}
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: top(d) for d in texts}


def reached(*roots: dict) -> dict:
    """doc_id: smallest doc_id reachable over the links of all the maps."""
    root = {d: d for d in roots[0]}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for r in roots:
        for a, b in r.items():
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {d: top(d) for d in root}


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
