"""Plain versions of the text operators, one document at a time, to compare results with."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def repeated_bytes(docs: list[tuple], length: int = 100) -> dict:
    """doc_id -> bytes, removed bytes, spans, hash of the rest; docs (unique ids, null last) in any order."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out[doc_id] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


def shingle_set(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def near_components(docs: list[tuple]) -> list[tuple]:
    """doc_id, set size, component_id, kept for each row."""
    sets = [shingle_set(text) for _, text in docs]
    part = list(range(len(docs)))
    for a, b in combinations(range(len(docs)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            part = [part[a] if p == part[b] else p for p in part]
    out = []
    for i, (doc_id, _) in enumerate(docs):
        ids = [docs[k][0] for k in range(len(docs)) if part[k] == part[i] and docs[k][0] is not None]
        component = min(ids, default=None)
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return out


def kept_lines(docs: list[tuple], least: int = 5) -> dict:
    """doc_id -> text without the lines that an earlier one repeats, up to a word in lines of `least` words; unique ids, null last."""
    def near(a: list[str], b: list[str]) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        if len(a) < len(b):
            a, b = b, a
        return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    earlier, out = [], {}
    for doc_id, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        left = []
        for line in (text.split("\n") if text is not None else []):
            words = [w for w in re.split(r"[\x20\x09-\x0D]+", line) if w]
            if not words:
                left.append(line)
                continue
            if not any(words == e or (min(len(words), len(e)) >= least and near(words, e)) for e in earlier):
                left.append(line)
            earlier.append(words)
        out[doc_id] = "\n".join(left) if text is not None else None
    return out


def hits(docs: list[tuple], items: list[tuple], window: int = 13) -> list[tuple]:
    """doc_id, words, hit words, items, digest, contaminated."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))

    phrases: dict[tuple, set] = {}
    for name, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add("null" if name is None else str(name))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, found = set(), set()
        for phrase, names in phrases.items():
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i : i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    found |= names
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out
