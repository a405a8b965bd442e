"""Plain versions of the corpus operators, for small tables."""

import math
import re
from collections import Counter, defaultdict

SF = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group(0).lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def shingles(ws, size=5):
    return {tuple(ws[k : k + size]) for k in range(max(1, len(ws) - size + 1))} if ws else set()


def near_components(docs):
    """doc_id -> (set size, component) of (doc_id, text) with distinct ids."""
    sets = {i: shingles(words(t)) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 4 >= 3 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def leaks(docs, items, least=0.75):
    """(doc_id, item_id) -> similarity of the best window that shares a shingle."""
    shingle_sets = {i: shingles(words(t)) for i, t in items if words(t)}
    sizes = {i: len(words(t)) for i, t in items}
    df = Counter(g for s in shingle_sets.values() for g in s)
    weight = lambda g: math.log(1 + (len(shingle_sets) + 1) / (df[g] or 1))
    inverted = defaultdict(set)
    for i, s in shingle_sets.items():
        for g in s:
            inverted[g].add(i)
    found = {}
    for d, text in docs:
        ws = words(text)
        met = {i for g in shingles(ws) for i in inverted.get(g, ())}
        for i in met:
            n, best = sizes[i], 0.0
            for at in range(max(1, len(ws) - n + 1)):
                a, b = shingles(ws[at : at + n]), shingle_sets[i]
                best = max(best, sum(map(weight, a & b)) / sum(map(weight, a | b)))
            if best >= least - 1e-9:
                found[d, i] = best
    return found


def fill_targets(sizes, weights):
    """Targets of sources by sharing again what stopped sources can't take."""
    total, out, left = sum(sizes.values()), {}, dict(weights)
    while left:
        level = total / sum(left.values())
        stopped = [s for s in left if left[s] * level > 3 * sizes[s]]
        if not stopped:
            out.update({s: w * level for s, w in left.items()})
            break
        for s in stopped:
            out[s] = 3 * sizes[s]
            total -= out[s]
            del left[s]
    return out


def sainte_lague(shares, seats):
    """Seats one by one to the highest quotient, ties by name."""
    got = dict.fromkeys(shares, 0)
    for _ in range(seats):
        best = max(sorted(shares), key=lambda s: shares[s] / (2 * got[s] + 1))
        got[best] += 1
    return got
