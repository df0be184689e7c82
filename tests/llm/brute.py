"""Plain versions of the operators, for small inputs."""

import collections
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def removed(texts, length, keep_first):
    """For each text a flag per byte."""
    seen = collections.defaultdict(list)
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]].append((i, p))
    flags = [bytearray(len(b)) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places[1:] if keep_first else places:
                flags[i][p : p + length] = b"\x01" * length
    return data, flags


def repeated_words(texts, length, keep_first):
    """The bytes of each text, and the stretches of those words of it that stand in a window of `length` words found twice."""
    seen = collections.defaultdict(list)
    data = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    hit = [bytearray(len(p)) for p in places]
    for i, (b, p) in enumerate(zip(data, places, strict=True)):
        words = [b[x:y] for x, y in p]
        for k in range(len(words) - length + 1):
            seen[tuple(words[k : k + length])].append((i, k))
    for found in seen.values():
        if len(found) > 1:
            for i, k in found[1:] if keep_first else found:
                hit[i][k : k + length] = b"\x01" * length
    out = []
    for p, h in zip(places, hit, strict=True):
        spans, at = [], 0
        while (i := h.find(1, at)) >= 0:
            j = h.find(0, i)
            at = len(h) if j < 0 else j
            spans.append((p[i][0], p[at - 1][1]))
        out.append(spans)
    return data, out


def components(ids, texts, words, percent):
    sets = []
    for t in texts:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(zip(ids, sets, strict=True)):
        for b, t in zip(ids[:i], sets[:i], strict=True):
            both = len(s & t)
            if both and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def contamination(docs, items, window):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        if i is not None and w:
            n = min(window, len(w))
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(i)
    out = []
    for t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((len(w), sum(hit), sorted(found)))
    return out


def quality(text):
    w = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    five = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if five[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
