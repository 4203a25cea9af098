"""Plain forms of what the operators compute."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def root_of(links: list[tuple[int, int]], n: int) -> list[int]:
    parent = list(range(n))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(k) for k in range(n)]


def simhash(text: str | None) -> int:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(ids: list[int], prints: list[int], radius: int = 2) -> dict[int, int]:
    p = np.array(prints, np.uint64)
    links = []
    for k in range(len(p)):
        near = np.flatnonzero(np.bitwise_count(p ^ p[k]) <= radius)
        links += [(k, int(j)) for j in near]
    roots = root_of(links, len(p))
    least: dict[int, int] = {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, ids[k]), ids[k])
    return {ids[k]: least[r] for k, r in enumerate(roots)}


def base_quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    inside = set()
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            inside.update(range(k, k + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text: str | None) -> tuple[int, int, int, str]:
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    named = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
    counts = Counter(k for _, k, _ in spans)
    return counts[0], counts[1], counts[2], hashlib.sha256(",".join(named).encode()).hexdigest()


def exact_groups(rows: list[tuple]) -> list[tuple]:
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text) rows with unique ids."""
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups: dict[str, list[int]] = {}
    for k, n in enumerate(norm):
        groups.setdefault(n, []).append(k)
    keep = {n: min(ks, key=lambda k: (-len(rows[k][1] or ""), rows[k][0])) for n, ks in groups.items()}
    return [(d, rows[keep[n]][0], len(groups[n]), keep[n] == k, hashlib.sha256(n.encode()).hexdigest()) for k, ((d, _), n) in enumerate(zip(rows, norm))]


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def auc(scores: list[float], labels: list[int]) -> float:
    order = np.argsort(scores, kind="stable")
    s, y = np.array(scores)[order], np.array(labels)[order]
    ranks = np.empty(len(s))
    k = 0
    while k < len(s):
        j = k
        while j < len(s) and s[j] == s[k]:
            j += 1
        ranks[k:j] = (k + j + 1) / 2
        k = j
    pos = y.sum()
    return float((ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))
