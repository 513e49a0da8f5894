"""Plain versions of the operators, for comparison on small tables."""

import hashlib
import math
from collections import Counter, defaultdict

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def near_duplicates(rows, size=4, percent=80):
    """``{doc_id: (n_shingles, component_id)}`` by comparing all pairs that share a shingle."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if len(w) >= size:
            sets[i] = frozenset(zip(*[w[j:] for j in range(size)]))
        else:
            sets[i] = frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    having = defaultdict(list)
    for i in sets:
        for s in sets[i]:
            having[s].append(i)
    for i in sets:
        for j, n in Counter(j for s in sets[i] for j in having[s] if j < i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(rows, width=100):
    """``{doc_id: (spans, kept bytes)}`` by a table of all windows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    first = {}
    for i, b in rows:
        for t in range(len(b) - width + 1):
            first.setdefault(b[t : t + width], (i, t))
    out = {}
    for i, b in rows:
        covered = bytearray(len(b))
        for t in range(len(b) - width + 1):
            if first[b[t : t + width]] != (i, t):
                covered[t : t + width] = b"\1" * width
        edges = [k for k in range(len(b) + 1) if (covered[k - 1] if k else 0) != (covered[k] if k < len(b) else 0)]
        spans = list(zip(edges[::2], edges[1::2]))
        out[i] = spans, bytes(c for c, f in zip(b, covered) if not f)
    return out


def uniform(key, seed):
    return (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def copies(doc_id, rate, seed="mix"):
    """Inverse of the Poisson distribution, term by term."""
    u, n = uniform("" if doc_id is None else str(doc_id), seed), 0
    term = total = math.exp(-rate)
    while total <= u:
        n += 1
        term *= rate / n
        total += term
    return n


def root_rates(sources, power=0.5):
    sizes = Counter(sources)
    total, whole = sum(sizes.values()), sum(n**power for n in sizes.values())
    return {s: n**power / whole * total / n for s, n in sizes.items()}
