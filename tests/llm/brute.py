"""Plain Python versions of the query contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lower(x: str | None) -> bytes:
    return (x or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def sharded(rows, shards=8):
    """(doc_id, text) -> (doc_id, size, crc, shard, slot), ordered like the engine orders."""
    items = sorted(
        ((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]),
    )
    total, at, out, count = sum(r[1] for r in items), 0, [], Counter()
    for i, size, crc in items:
        at += size
        shard = min(shards - 1, int((2 * at - size) / (2 * total / shards)))
        out.append((i, size, crc, shard, count[shard]))
        count[shard] += 1
    return out


def repeated_words(rows, window=35):
    """One result per row; rows are told apart by their place."""
    docs = [WORDS.findall((t or "").encode()) for _, t in rows]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for (i, _), d in zip(rows, docs, strict=True):
        gone = [False] * len(d)
        for k in range(len(d) - window + 1):
            if seen[tuple(d[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(d), sum(gone), sha(b" ".join(w for w, g in zip(d, gone, strict=True) if not g))))
    return out


def repeated_bytes(rows, length=100):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], k))
    seen, out = set(), {}
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            piece = raw[s : s + length]
            if piece in seen:
                gone[s : s + length] = b"\x01" * length
            else:
                seen.add(piece)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[k] = (rows[k][0], len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g)))
    return [out[k] for k in range(len(rows))]


def shingles(text):
    w = WORDS.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    both = Counter()
    for found in index.values():
        for a in range(len(found)):
            for b in range(a + 1, len(found)):
                both[found[a], found[b]] += 1
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


def contaminated(rows, items, window=10):
    index = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            index[tuple(w[k : k + window])].add(item)
    lengths = {len(x) for x in index}
    out = []
    for i, t in rows:
        w = ALNUM.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                got = index.get(tuple(w[k : k + n]))
                if got:
                    found |= got
                    hit[k : k + n] = [True] * n
        ids = sorted(map(str, found))
        out.append((i, len(w), sum(hit), len(ids), sha(",".join(ids)), any(hit)))
    return out


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out.append((i, len(t), sha(t[: len(t) - cut] + following[:cut])))
    return out


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(rows):
    out = []
    for i, t in rows:
        t = t or ""
        n_digits = lambda m: len(re.sub("[^0-9]", "", m.group()))
        found = {
            "email": list(EMAIL.finditer(t)),
            "ip": [m for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))],
            "card": [m for m in CARD.finditer(t) if 13 <= n_digits(m) <= 19 and luhn(re.sub("[^0-9]", "", m.group()))],
            "phone": [m for m in PHONE.finditer(t) if 9 <= n_digits(m) <= 15],
        }
        spans = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in found.items() for m in ms)
        out.append((i, *(len(found[k]) for k in ("email", "ip", "card", "phone")), sha(spans), spans))
    return out
