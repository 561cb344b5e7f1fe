"""Plain versions of what the operators compute."""

import re

UP = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(UP)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def solid_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingle_set(text):
    w = solid_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def classes(rows):
    """doc index -> smallest id of its class, over (id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                up[top(i)] = top(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[top(i)] = min(best.get(top(i), d), d)
    return [best.get(top(i)) for i in range(len(rows))]


def hits(text, items, width=10):
    """(word count, hit places, item ids) of a text."""
    w = alnum_words(text)
    marked, found = set(), set()
    for item, body in items:
        b = alnum_words(body)
        size = min(width, len(b))
        windows = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1):
            if windows and tuple(w[i : i + size]) in windows:
                marked.update(range(i, i + size))
                if item is not None:
                    found.add(str(item))
    return len(w), marked, sorted(found)
