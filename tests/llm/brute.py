"""Plain Python versions of the contracts, for comparison on small tables."""

import hashlib
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        again += line in seen and bool(WORD.search(line))
        seen.add(line)
    grams, hit = {}, set()
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in grams.values():
        if len(at) > 1:
            hit.update(i + k for i in at for k in range(8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(hit)


def contamination(docs, items, n=10):
    """docs: {id: text}, items: [(item_id, text)] -> {id: (words, hits, items)}"""
    grams = {}
    for item, text in items:
        w = LETTERS.findall(lower(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = sorted({len(g) for g in grams})
    out = {}
    for k, text in docs.items():
        w, hit, found = LETTERS.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i : i + size])) in grams:
                    hit.update(range(i, i + size))
                    found |= grams[g]
        out[k] = len(w), len(hit), sorted(found, key=lambda s: s.encode())
    return out


def shingles(text):
    w = WORD.findall(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def components(docs):
    """{id: text} -> {id: (shingles, component)} from all pairs that share a shingle."""
    sets = {k: shingles(t) for k, t in docs.items()}
    index, up = {}, {k: k for k in docs}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k in sorted(docs):
        shared = {}
        for s in sets[k]:
            for o in index.setdefault(s, []):
                shared[o] = shared.get(o, 0) + 1
            index[s].append(k)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[o]) - n):
                a, b = sorted((top(k), top(o)))
                up[b] = a
    return {k: (len(sets[k]), top(k)) for k in docs}


def crc(text):
    return zlib.crc32((text or "").encode())


BASE = {
    "assign": (re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def secrets(text):
    """[(kind, start, end)] by start, then kind as listed."""
    found = [(m.start(), i, kind, m.end()) for i, (kind, (p, ok)) in enumerate(BASE.items()) for m in p.finditer(text or "") if ok(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]
