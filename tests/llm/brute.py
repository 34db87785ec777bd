"""Plain Python versions of what the operators return, for small inputs."""

import base64
import hashlib
import re

WINDOW = 10


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def leaks(text, items):
    """n_words, n_hit and the sorted items of a text; ``items`` are (id, text)."""
    words = alnum_words(text)
    hit, found = set(), set()
    for item, own in items:
        w = alnum_words(own)
        n = min(WINDOW, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def shingles(text, k):
    words = space_words(lower(text))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def groups(docs, k, percent):
    """{id: (set size, component)} for a dict of texts."""
    sets = {d: shingles(t, k) for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """kind:start:end by start, then kind as listed."""
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    out = [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for n, (kind, (pattern, good)) in enumerate(kinds.items()) for m in re.finditer(pattern, text) if good(m)]
    return [x for *_, x in sorted(out)]


def pieces(word, first, later):
    """Number of greedy pieces of a word; 1 if they do not spell it."""
    at, n, table = 0, 0, first
    while at < len(word):
        size = next((s for s in range(len(word) - at, 0, -1) if word[at : at + s] in table), 0)
        if not size:
            return 1
        at, n, table = at + size, n + 1, later
    return n


def digest(html):
    raw = (html or "").encode()
    return len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()


def targets(sizes, weights=(5.0, 2.0, 1.0), cap=3.0):
    """Target of each source from a list of sizes in source order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free:
        level = left / sum(w[i] for i in free)
        full = {i for i in free if level * w[i] > cap * sizes[i]}
        if not full:
            for i in free:
                out[i] = level * w[i]
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
        free -= full
    return out
