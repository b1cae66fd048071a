"""Brute-force versions of the operators, one document after another."""

import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, width=5, lower=lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)):
    ws = words(lower(text or ""))
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {n: find(n) for n in nodes}


def similar(sets, percent=80):
    names = [k for k, s in sets.items() if s]
    for i, a in enumerate(names):
        for b in names[:i]:
            shared = len(sets[a] & sets[b])
            if (100 + percent) * shared >= percent * (len(sets[a]) + len(sets[b])):
                yield a, b


def near_copies(docs, percent=80):
    """doc_id -> smallest doc_id reachable."""
    return roots([i for i, _ in docs], similar({i: shingles(t) for i, t in docs}, percent))


def char_shingles(line, width):
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def dedup_lines(docs, width=8, percent=80):
    """doc_id -> shortened text; ids in rising order."""
    docs = sorted((i, t or "") for i, t in docs)
    lines = {x for _, t in docs for x in t.split("\n") if x.strip()}
    long = {x: char_shingles(x, width) for x in lines if len(x) > width}
    root = roots(lines, similar(long, percent))
    seen, out = set(), {}
    for i, t in docs:
        kept = []
        for x in t.split("\n"):
            if x.strip():
                if root[x] in seen:
                    continue
                seen.add(root[x])
            kept.append(x)
        out[i] = "\n".join(kept)
    return out


def contaminated(docs, items, percent=80):
    lower = str.lower
    for i, t in docs:
        s = shingles(t, lower=lower)
        for k, item in items:
            q = shingles(item, lower=lower)
            if q and 100 * len(s & q) >= percent * len(q):
                yield i, k, len(q), len(s & q)


def lm_scores(docs, share=1e-4, least=2, backoff=0.4, order=3):
    split = {i: words((t or "").lower()) for i, t in docs}
    total = sum(map(len, split.values()))
    count = Counter(w for ws in split.values() for w in ws)
    ids = {i: [w if count[w] >= share * total else None for w in ws] for i, ws in split.items()}
    grams = Counter(tuple(ws[k : k + n]) for ws in ids.values() for n in range(1, order + 1) for k in range(len(ws) - n + 1))

    def score(g):
        if len(g) == 1:
            return grams[g] / total
        return grams[g] / grams[g[:-1]] if grams[g] >= least else backoff * score(g[1:])

    return {i: (len(ws), sum(math.log(score(tuple(ws[max(0, k - order + 1) : k + 1]))) for k in range(len(ws))) / len(ws) if ws else None) for i, ws in ids.items()}


def gram_list(text, size, orders=(1, 2, 3)):
    """Most frequent n-grams of a text in order, as the language profiles count them."""
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    counts = Counter()
    for w in text.split():
        counts.update(f" {w} "[k : k + n] for n in orders for k in range(len(w) + 3 - n) if f" {w} "[k : k + n].strip())
    return counts


def profile(counts, size):
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def languages(labelled, docs, size):
    """doc_id -> language and score."""
    counts = defaultdict(Counter)
    for text, lang in labelled:
        counts[lang] += gram_list(text, size)
    places = {lang: {g: k for k, g in enumerate(profile(c, size))} for lang, c in sorted(counts.items())}
    out = {}
    for i, text in docs:
        own = profile(gram_list(text, size), size)
        if not own or not places:
            out[i] = ("und", 0.0)
            continue
        far = {lang: sum(abs(at[g] - k) if g in at else size for k, g in enumerate(own)) for lang, at in places.items()}
        best = min(far, key=far.get)
        out[i] = (best, 1 - far[best] / (size * len(own)))
    return out


def first_fit(lengths, capacity):
    rooms, out = [], []
    for n in lengths:
        at = next((k for k, r in enumerate(rooms) if r >= n), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        out.append((at, capacity - rooms[at]))
        rooms[at] -= n
    return out
