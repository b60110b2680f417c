"""Plain versions of the corpus operators, for small tables."""

import re

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(rows):
    """{doc_id: (n_lines, n_dropped, kept text)}"""
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate(UP) for x in t.split("\n")]
    first = {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        for key in keys(t or ""):
            first.setdefault(key, k)
    out = {}
    for k, t in rows:
        parts = (t or "").split("\n")
        kept = [p for p, key in zip(parts, keys(t or "")) if len(key) < 10 or first[key] == k]
        out[k] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def smallest_reachable(names, links):
    root = {k: k for k in names}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in names}


def near(rows, percent=85):
    """{doc_id: (n_shingles, component)}"""
    sets = {k: shingles(t) for k, t in rows}
    shared = {}
    holders = {}
    for k in sorted(sets):
        for s in sets[k]:
            for other in holders.setdefault(s, []):
                shared[other, k] = shared.get((other, k), 0) + 1
            holders[s].append(k)
    links = [(a, b) for (a, b), n in shared.items()
             if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    comp = smallest_reachable(sets, links)
    return {k: (len(sets[k]), comp[k]) for k in sets}


def substrings(rows, length=50):
    """{doc_id: removed flags}"""
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone, own = bytearray(len(data)), set()
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            own.add(w)
            if w in seen:
                gone[i:i + length] = b"\1" * length
        seen |= own
        out[k] = (data, bytes(gone))
    return out
