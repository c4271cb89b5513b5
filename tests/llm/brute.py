"""Plain-Python versions of the corpus operators' results, for comparison."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import xxhash

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    spans = []
    for k, (name, (pattern, group, least)) in enumerate(BASE.items()):
        spans += [(m.start(), k, name, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(spans)


def base_digest(text: str) -> str:
    return sha(",".join(f"{name}:{start}:{end}" for start, _, name, end in base_spans(text)))


def hot_stretch(run: str, window: int, threshold: float) -> tuple[int, int] | None:
    """First and last window start whose entropy reaches the threshold, counted afresh."""
    hot = []
    for i in range(len(run) - window + 1):
        counts = Counter(run[i : i + window])
        if -sum(c / window * log2(c / window) for c in counts.values()) >= threshold - 1e-9:
            hot.append(i)
    return (hot[0], hot[-1]) if hot else None


def conversations(rows: list[tuple]) -> dict:
    """conv_id -> (n_turns, turns digest, loss chars, loss digest) of (conv_id, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def crc(data: bytes) -> int:
    return zlib.crc32(data)


def fingerprint(text: str, width: int = 4) -> int:
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list[int], prints: list[int], bits: int = 4) -> dict[int, int]:
    """Smallest id reachable over fingerprints at most ``bits`` apart, all pairs compared."""
    distinct = sorted(set(prints))
    array = np.array(distinct, np.uint64)
    parent = list(range(len(distinct)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1 :] ^ array[i]) <= bits) + i + 1:
            parent[root(int(j))] = root(i)
    place = {p: i for i, p in enumerate(distinct)}
    least: dict[int, int] = {}
    for doc, p in zip(ids, prints, strict=True):
        r = root(place[p])
        least[r] = min(least.get(r, doc), doc)
    return {doc: least[root(place[p])] for doc, p in zip(ids, prints, strict=True)}


def word_lm(rows: list[tuple[int, str]]) -> dict[int, tuple]:
    """doc -> (held_out, n_tokens, n_known, N, base score) of (doc_id, text)."""
    from math import log10

    tokens = {d: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"\n"] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {
        d: (held[d], len(ws), sum(w in counts for w in ws), n, sum(log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for d, ws in tokens.items()
    }


def lattice_probability(word: str, pieces: dict[str, float], byte: list[float]) -> float:
    """Summed probability of all segmentations, from the end backwards."""
    from math import exp

    marked = "▁" + word
    rest = [0.0] * len(marked) + [1.0]
    for i in reversed(range(len(marked))):
        for j in range(i + 1, len(marked) + 1):
            if marked[i:j] in pieces:
                rest[i] += exp(pieces[marked[i:j]]) * rest[j]
        if i:
            p = 1.0
            for b in marked[i].encode():
                p *= exp(byte[b])
            rest[i] += p * rest[i + 1]
    return rest[0]


def word_scores(rows: list[tuple[int, str]], pieces: dict[str, float], byte: list[float], end: float) -> dict[int, float]:
    """doc -> log10 of the text's probability: training words by count, all words by their segmentations."""
    from math import exp, log10

    tokens = {d: [*re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()), b"\n"] for d, t in rows}
    counts = Counter(w for d, ws in tokens.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    value = {}
    for w in {w for ws in tokens.values() for w in ws}:
        q = exp(end) if w == b"\n" else lattice_probability(w.decode(), pieces, byte)
        value[w] = log10((counts[w] + v * q) / (n + v))
    return {d: sum(value[w] for w in ws) for d, ws in tokens.items()}


def line_report(rows: list[tuple[int, str]], similarity: float = 0.8, least_words: int = 1) -> dict[int, tuple]:
    """doc -> (n_lines, n_removed, links of the lines that stay, removed lines), all pairs of line sets compared."""
    first: dict[frozenset, tuple] = {}
    places = []
    n_lines = {}
    for d, text in sorted(rows):
        lines = (text or "").split("\n")
        n_lines[d] = len(lines)
        for i, line in enumerate(lines):
            words = frozenset(w for w in re.split(r"[\x20\x09-\x0d]+", line.lower()) if w)
            if len(words) >= least_words:
                first.setdefault(words, (d, i))
                places.append((d, i, words))
    sets = sorted(first, key=first.get)
    holders = defaultdict(list)
    links: Counter = Counter()
    removed_sets = set()
    for k, s in enumerate(sets):
        near = {j for w in s for j in holders[w]}
        for j in near:
            both = len(s & sets[j])
            if both / (len(s) + len(sets[j]) - both) >= similarity - 1e-9:
                links[k] += 1
                links[j] += 1
                removed_sets.add(k)
        for w in s:
            holders[w].append(k)
    number = {s: k for k, s in enumerate(sets)}
    out = {d: [n, [], 0] for d, n in n_lines.items()}
    for d, i, s in places:
        k = number[s]
        if first[s] != (d, i) or k in removed_sets:
            out[d][1].append(i)
        else:
            out[d][2] += links[k]
    return {d: (n, len(gone), linked, ",".join(map(str, sorted(gone)))) for d, (n, gone, linked) in out.items()}
