"""Plain versions of the operators for small inputs."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=4):
    w = words(lower(text))
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def components(rows, percent=85):
    """{doc_id: smallest doc_id reachable}; null ids take part but name nothing."""
    sets = [(i, shingles(t)) for i, t in rows]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                group[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            r = find(x)
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(find(x)) if s else i) for x, (i, s) in enumerate(sets)]


def removal(rows, width=20):
    """[(doc_id, n_words, n_removed, sha256)] for rows with distinct ids or repeated whole rows; null ids last."""
    order = sorted({(i is None, i, t) for i, t in rows}, key=lambda r: (r[0], r[1] or 0))
    first, out = {}, {}
    for _, i, t in order:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in first:
                gone[k : k + width] = [True] * width
            else:
                first[key] = True
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[i, t] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return [(i, *out[i, t]) for i, t in rows]


def base_counts(text):
    w = words(text)
    lines = (text or "").split("\n")
    seen, dup = set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else {g for g, n in __import__("collections").Counter(grams).items() if n > 1}
    cover = {i + k for i, g in enumerate(grams) if g in twice for k in range(3)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(cover))
