"""Plain Python versions of the operators, for small tables."""

import math
import re
from collections import defaultdict

import numpy as np

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits(docs, items, width=10):
    """{doc: (words, hit words, items)} of [(id, text)] and [(item, text)]."""
    windows = defaultdict(set)
    for item, text in items:
        words = PLAIN.findall((text or "").translate(LOWER))
        if words:
            n = min(width, len(words))
            for k in range(len(words) - n + 1):
                windows[tuple(words[k:k + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = PLAIN.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                for_window = windows.get(tuple(words[k:k + n]))
                if for_window:
                    hit.update(range(k, k + n))
                    found |= for_window
        out.append((doc, len(words), len(hit), sorted(found)))
    return out


def line_runs(docs, least=50):
    """[(id, text)] with later copies of runs of at least `least` words deleted; ids distinct and not null."""
    places, words = [], {}
    rows = {}
    for doc, text in sorted((d for d in docs if d[1] is not None), key=lambda d: d[0]):
        lines = text.split("\n")
        kept = [i for i, line in enumerate(lines) if SPACED.search(line)]
        rows[doc] = (lines, kept)
        for at, i in enumerate(kept):
            places.append((doc, at))
            words[doc, at] = len(SPACED.findall(lines[i]))

    def line(place):
        lines, kept = rows[place[0]]
        return lines[kept[place[1]]] if place[1] < len(kept) else None

    deleted = set()
    for k, place in enumerate(places):
        longest = 0
        for other in places[:k]:
            n = 0
            while line((place[0], place[1] + n)) is not None and line((place[0], place[1] + n)) == line((other[0], other[1] + n)):
                n += 1
            longest = max(longest, n)
        if sum(words[place[0], place[1] + n] for n in range(longest)) >= least:
            deleted |= {(place[0], place[1] + n) for n in range(longest)}
    out = {}
    for doc, text in docs:
        if text is None:
            out[doc] = None
            continue
        lines, kept = rows[doc]
        gone = set()
        for at, i in enumerate(kept):
            if (doc, at) in deleted:
                gone |= set(range(i, kept[at + 1] if at + 1 < len(kept) else len(lines)))
        out[doc] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def shingles(text, width):
    words = SPACED.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k:k + width]) for k in range(len(words) - width + 1))


def groups(docs, width=3, percent=90):
    """{id: (set size, smallest id reachable)}."""
    sets = {doc: shingles(text, width) for doc, text in docs}
    parent = {doc: doc for doc in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {doc: (len(sets[doc]), root(doc)) for doc in ids}


def counts(text):
    """(words, characters, symbols, repeated lines, repeated words, capitals, punctuation)."""
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    at = defaultdict(list)
    for k in range(len(words) - 7):
        at[tuple(words[k:k + 8])].append(k)
    repeated = {p for places in at.values() if len(places) > 1 for k in places for p in range(k, k + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated),
            sum(c.isupper() for c in text), len(re.findall(r"[.,!?;:]", text)))


def outliers(rows, least=50, core=0.75, steps=5, z=6.0, floor=0.02, grid=256, fine=50, full=200):
    """{id: kept} of [(id, text, lang, source)]; the same estimates, in numpy."""
    found = {doc: (counts(text), lang, source) for doc, text, lang, source in rows}
    failed = {doc: c[0] < 20 or 100 * c[4] > 30 * c[0] for doc, (c, _, _) in found.items()}
    good = [doc for doc in found if not failed[doc]]
    sizes, small = defaultdict(int), defaultdict(int)
    for doc in good:
        sizes[found[doc][1:]] += 1
    for (lang, _), n in sizes.items():
        small[lang] += n if n < least else 0
    rest = sum(n for (lang, _), n in sizes.items() if n < least and small[lang] < least)

    def unit(doc):
        _, lang, source = found[doc]
        if sizes[lang, source] >= least:
            return lang, source
        return (lang,) if small[lang] >= least else () if rest >= least else None

    members = defaultdict(list)
    for doc in good:
        members[unit(doc)].append(doc)
    kept = {doc: not failed[doc] for doc in found}
    chi = lambda q: 4 * (1 - 2 / 36 + q * (2 / 36) ** 0.5) ** 3

    def quantile(buckets, share):
        ordered = sorted(buckets)
        return ordered[max(0, math.ceil(share * len(ordered)) - 1)]

    for name, docs in members.items():
        if name is None:
            continue
        c = np.array([found[d][0] for d in docs], float)
        x = np.column_stack([np.log(c[:, 1] / c[:, 0])] + [np.arcsin(np.sqrt(np.minimum(1, c[:, k] / c[:, 1]))) for k in (2, 5, 6)])
        b = np.clip(np.floor(x * grid), 0, 4096).astype(int)
        middle = np.array([quantile(b[:, i], 0.5) for i in range(4)])
        off = np.array([quantile(abs(b[:, i] - middle[i]), 0.5) for i in range(4)])
        mean, cov = (middle + 0.5) / grid, np.diag((1.4826 * off / grid + floor) ** 2)
        trust = np.minimum(1, c[:, 0] / full)
        square = lambda: np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) * trust
        for _ in range(steps):
            bucket = np.floor(np.log1p(square()) * fine).astype(int)
            inside = x[bucket <= quantile(bucket, core)]
            mean = inside.mean(0)
            cov = np.cov(inside.T, bias=True) + np.eye(4) * floor ** 2
        bucket = np.floor(np.log1p(square()) * fine).astype(int)
        scale = math.expm1((quantile(bucket, 0.5) + 0.5) / fine) / chi(0.0)
        for doc, d in zip(docs, square() / scale):
            kept[doc] = bool(d <= chi(z))
    return kept


def targets(sizes, weights=(1, 2, 3), most=3):
    """{source: target} of {source: size}: fill by weight, stop at the cap, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        share = (total - sum(capped.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: share * weight[s] for s in free}
        capped |= {s: most * sizes[s] for s in over}
