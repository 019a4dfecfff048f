"""Plain versions of the operators, for small fixtures."""

import hashlib
import re
from collections import defaultdict


def union(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    return [root(i) for i in range(n)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def near_duplicates(rows, k=3, threshold=85):
    """(doc_id, text) rows without null ids to sorted (doc_id, n, component, kept)."""
    sets = [shingles(t, k) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i)
             if rows[i][0] == rows[j][0] and sets[i] and sets[j]
             or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    roots, least = union(len(rows), links), {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(i, least.get(r, i))
    return sorted((i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(rows, sets, roots))


def line_sets(line):
    return frozenset(re.findall(r"(?s)(?=(.{1,16}))\S{1,8}\s*", line.strip(" ").lower(), re.A))


def dense_line_sets(line):
    line = line.strip(" ").lower()
    return frozenset(line[i:i + 5] for i in range(len(line) - 4)) or frozenset([line])


def line_components(rows, threshold=80, line_sets=line_sets):
    """(doc_id, text) rows to {(doc_id, line_no): first place of its component}."""
    places = defaultdict(list)
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            if re.search(r"\S", line, re.A):
                places[line.strip(" ").lower()].append((i, k))
    names = list(places)
    sets = [line_sets(x) for x in names]
    links = [(i, j) for i in range(len(names)) for j in range(i)
             if 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    first = {}
    roots = union(len(names), links)
    for x, r in zip(names, roots):
        first[r] = min([*places[x], *([first[r]] if r in first else [])])
    return {p: first[r] for x, r in zip(names, roots) for p in places[x]}


def removed(rows, span=50):
    """(doc_id, text) rows to sorted (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    least = {}
    for i, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - span + 1):
            w = raw[s:s + span]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - span + 1):
            if least[raw[s:s + span]] < i:
                gone[s:s + span] = b"\1" * span
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                    hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


def contaminated(rows, items, span=10):
    """(doc_id, text) rows and (item_id, text) items to sorted (doc_id, n_words, n_hit, item ids)."""
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s:s + n])].add(str(i))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s:s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)
