"""Plain restatements of the operators' contracts, for small inputs."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def simhash(text):
    words = BLANK_WORD.findall(lower(text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def near_duplicates(docs):
    prints = {i: simhash(t) for i, t in docs}
    ids = sorted(prints)
    found = components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    return {(i, f"{prints[i]:016x}", found[i]) for i in ids}


def contamination(docs, items, window=10):
    having = {}
    for item, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - window + 1) if words else 0):
            having.setdefault(tuple(words[i : i + window]), set()).add(item)
    lengths = {len(w) for w in having}
    out = set()
    for doc, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if got := having.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= got
        out.add((doc, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def substrings(docs, n=35):
    seen = {}
    split = [(i, BLANK_WORD.findall(t or "")) for i, t in docs]
    for at, (_, words) in enumerate(split):
        for p in range(len(words) - n + 1):
            seen.setdefault(tuple(words[p : p + n]), []).append((at, p))
    gone = [set() for _ in split]
    for places in seen.values():
        if len(places) > 1:
            for at, p in places:
                gone[at].update(range(p, p + n))
    return sorted(
        ((i, len(w), len(g), sha(" ".join(x for p, x in enumerate(w) if p not in g))) for (i, w), g in zip(split, gone)),
        key=str,
    )


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_secrets(text):
    """(start, kind number, end) of the base rule."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def license_base(text):
    words = WORD.findall(lower(text))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))
