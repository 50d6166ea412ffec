"""Plain restatements of what the operators return."""

import hashlib
import math
import re

SPACED, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def contamination(docs, items):
    windows = {}
    for item, text in items:
        words = ALNUM.findall(fold(text))
        n = min(10, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    out = []
    for _, text in docs:
        words, hit, found = ALNUM.findall(fold(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (own := windows.get(tuple(words[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((len(words), len(hit), sorted(str(i) for i in found if i is not None)))
    return out


def kept_words(docs, window=13):
    first = {}
    for i, text in docs:
        words = SPACED.findall(text or "")
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        words = SPACED.findall(text or "")
        gone = {j for k in range(len(words) - window + 1) if first[tuple(words[k : k + window])] < i for j in range(k, k + window)}
        out[i] = (len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone))
    return out


def shingles(text, size=4):
    words = SPACED.findall(fold(text))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])


def groups(docs, near=85):
    sets, root = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= near * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def targets(sizes):
    """Targets by source name: weights 1, 2, 3 again and again, nobody above 3 times its size, the excess reshared."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, fixed = {s: i % 3 + 1 for i, s in enumerate(names)}, {}
    while True:
        rest = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def copies(rows, goals, seed, long):
    """How often each (id, size) of one source comes; goals is its target."""
    number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:12], 16)
    (source, goal), = goals.items()
    key = lambda i: hashlib.md5((f"{seed}|{i}" if i is not None else f"{seed}").encode()).hexdigest()
    order = sorted(((size, key(i), i) for i, size in rows), key=lambda x: (x[0], x[1]), reverse=True)
    edge = order[long][:2] if len(order) > long else None
    first = [x for x in order if edge is None or x[:2] > edge]
    taken, left, place, out = 0, sum(x[0] for x in order), number(f"{seed}|{source or ''}") / 16**12, []
    rate = lambda: min(3.0, max(0.0, (goal - taken) / left)) if left > 0 else 0.0
    for size, _, i in first:
        expected = rate()
        if size:
            want, rest = goal - taken, 3 * (left - size)
            low, high = float(math.ceil((want - rest) / size)), float(math.floor(want / size))
            expected = min(max(expected, low), high) if low <= high else high if want - high * size - rest <= low * size - want else low
        to = place + min(3.0, max(0.0, expected))
        n = min(math.floor(to), 3)
        place, taken, left = to - n, taken + n * size, left - size
        out.append((i, size, n))
    band = lambda size: len(str(size)) * 10 + int(str(size)[0])
    own = rate()
    for k, (size, _, i) in enumerate(sorted(order[len(first) :], key=lambda x: (-band(x[0]), -x[0], x[1]))):
        out.append((i, size, min(3, math.floor((k + 1) * own + place) - math.floor(k * own + place))))
    return sorted(out, key=str)
