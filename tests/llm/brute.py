"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import combinations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2)))


def components(docs):
    """{(doc_id, n_shingles, component_id)} for unique ids."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by_shingle[x].add(i)
    pairs = {tuple(sorted(p)) for ids in by_shingle.values() for p in combinations(ids, 2)}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {(i, len(sets[i]), root(i)) for i in sets}


def repeats(docs, length=50):
    """{(doc_id, n_bytes, n_removed, n_spans, sha256)} for unique ids."""
    first = {}
    data = {i: (t or "").encode() for i, t in docs}
    for i in sorted(data):
        for p in range(len(data[i]) - length + 1):
            first.setdefault(data[i][p : p + length], i)
    out = set()
    for i, text in data.items():
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if first[text[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out.add((i, len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contamination(docs, items, window=13):
    """Rows (doc_id, n_words, n_hit, n_items, sha256, contaminated)."""
    windows = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            windows[tuple(words[i : i + window])].add(str(item) if item is not None else "null")
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for p in range(len(words) - n + 1):
                if (w := tuple(words[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[w]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return Counter(out)


def aligned(docs, a, b):
    """{(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)} of whole texts encoded at
    once; ``a``: tokenizers, ``b``: sentencepiece.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    vocabulary = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    found = []
    for i, text in docs:
        whole = (" " + (text or "")).encode()
        xs = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ys = b.encode(text) if text else []
        x_bytes = [vocabulary[x] for x in xs]
        y_bytes = [bytes([int(b.id_to_piece(y)[3:5], 16)]) if b.is_byte(y) else b.id_to_piece(y).replace("▁", " ").encode() for y in ys]
        parts = []
        if text and b"".join(x_bytes) == whole == b"".join(y_bytes):
            ends = []
            for pieces in (x_bytes, y_bytes):
                at, out = 0, []
                for p in pieces:
                    at += len(p)
                    out.append(at)
                ends.append(out)
            common = sorted(set(ends[0]) & set(ends[1]))
            parts = [([], []) for _ in common]
            for side, (ids, es) in enumerate(zip((xs, ys), ends, strict=True)):
                for t, e in zip(ids, es, strict=True):
                    parts[bisect_left(common, e)][side].append(t)
        found.append((i, parts))
    count = Counter(p for _, parts in found for p in {(x, y) for g in parts for x in g[0] for y in g[1]})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, parts in found:
        links = [(x, y) for g in parts for x in g[0] for y in g[1]]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in parts)
        sha = hashlib.sha256(text.encode()).hexdigest() if parts else ""
        out.append((
            i, sum(len(g[0]) for g in parts), sum(len(g[1]) for g in parts), len(parts), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha,
        ))
    return Counter(out)


def spelling(docs, least=7, times=10):
    """Rows (word, form, root, n, n_near, form_n); words meet through all strings that both give by
    leaving out one letter.
    """
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    shorter = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add((i, w))
    near = defaultdict(set)
    for s, made in shorter.items():
        if s in words:
            for _, w in made:
                near[s].add(w)
                near[w].add(s)
        by_place = defaultdict(set)
        for i, w in made:
            by_place[i].add(w)
        for same in by_place.values():
            for w in same:
                near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= times * n:
                form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return Counter(out)


def secrets(docs, max_owners=3):
    """Rows (doc_id, base spans, all spans) of (doc_id, repository, owner, text)."""
    patterns = [
        ("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6),
        ("access", "(AKIA[A-Z0-9]+)", 20), ("hex", "([0-9a-f]+)", 24),
    ]
    found, owners = [], defaultdict(set)
    for doc_id, _, owner, text in docs:
        spans = [(m.start(), k, m.end(), kind, m[1]) for k, (kind, p, least) in enumerate(patterns)
                 for m in re.finditer(p, text or "", re.ASCII) if len(m[1]) >= least]
        for m in re.finditer("[A-Za-z0-9_-]{16,}", text or ""):
            digits, letters = sum(c.isdigit() for c in m[0]), sum(c.isalpha() for c in m[0])
            if digits >= 3 and letters >= 3 and len(set(m[0])) >= 8 and not any(s[0] < m.end() and s[2] > m.start() for s in spans if s[1] < 3):
                spans.append((m.start(), 3, m.end(), "owned", m[0]))
        for s in spans:
            owners[s[4]].add(owner)
        found.append((doc_id, sorted(spans)))
    show = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind, _ in spans)
    return Counter(
        (i, show(s for s in spans if s[1] < 3), show(s for s in spans if s[1] < 3 or len(owners[s[4]]) <= max_owners))
        for i, spans in found
    )
