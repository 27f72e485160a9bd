"""Plain versions of what the operators do, for small tables."""

from collections import Counter, defaultdict

import duckdb
import numpy as np

WORD = r"[^\x20\x09-\x0D]+"


def table(sf_dir, name):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").df()


def texts(sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    return {i: t for i, t in rows}


def shingles(text, width=5):
    words = (text or "").split()
    if not words:
        return Counter()
    return Counter(tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, 1)))


def closed(nodes, links):
    """Smallest node that links reach, for every node."""
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {n: root(n) for n in nodes}


def near_components(docs, least=0.8):
    held = {i: shingles(t) for i, t in docs.items()}
    met = defaultdict(list)
    for i, counted in held.items():
        for s in counted:
            met[s].append(i)
    pairs = {(a, b) for ids in met.values() for n, a in enumerate(ids) for b in ids[n + 1 :]}
    links = [
        (a, b) for a, b in pairs
        if sum((held[a] & held[b]).values()) >= least * sum((held[a] | held[b]).values())
    ]
    return closed(docs, links)


def near_vectors(ids, vectors, cosine=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= cosine, 1))
    pairs = [(ids[x], ids[y]) for x, y in zip(a, b)]
    return Counter(i for p in pairs for i in p), closed(ids, pairs)


def line_dedup(docs, least=50):
    """Texts without later runs of whole lines, smallest with `least` words, that stand earlier."""
    runs, lines, numbered = defaultdict(list), {}, {}
    for i in sorted(docs):
        lines[i] = (docs[i] or "").split("\n")
        numbered[i] = own = [(k, x, len(x.split())) for k, x in enumerate(lines[i]) if x.split()]
        found = set()
        for s in range(len(own)):
            words = 0
            for e in range(s, len(own)):
                words += own[e][2]
                if words >= least:
                    found.add((s, e))
                    break
        for e in range(len(own)):
            words = 0
            for s in range(e, -1, -1):
                words += own[s][2]
                if words >= least:
                    found.add((s, e))
                    break
        for s, e in found:
            runs["\n".join(x for _, x, _ in own[s : e + 1])].append((i, s, e))
    gone = defaultdict(set)
    for places in runs.values():
        for i, s, e in sorted(places)[1:]:
            gone[i].update(k for k, _, _ in numbered[i][s : e + 1])
    return {i: "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i]) for i in docs}


def source_targets(sizes):
    """Targets of sources given as {source: words}; None sorts last."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    target, free, left = {}, set(order), sum(sizes.values())
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target
