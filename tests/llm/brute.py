"""Plain Python versions of what the operators compute, for small inputs."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, duplicates = set(), 0
    for line in lines:
        duplicates += line in seen
        seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), sum(map(len, w)), symbols, duplicates, len(covered)


def shingles(text, k):
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def near_components(docs, k, percent):
    """Least id reachable of each id, from all pairs."""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in sets}


def edit_distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, line = line, [i]
        for j, y in enumerate(b, 1):
            line.append(min(above[j] + 1, line[-1] + 1, above[j - 1] + (x != y)))
    return line[-1]


def holds_item(text, item, max_edits=0.2):
    """The least distance of an item-sized window of the text, if it is small enough."""
    w, target = words(text, lower=True), words(item, lower=True)
    n = len(target)
    gaps = [edit_distance(w[i : i + n], target) for i in range(max(len(w), 1))]
    best = min(gaps)
    return best if best <= int(n * max_edits + 1e-9) else None


ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(found))


def base_scores(docs, key=lambda d: d):
    """Per id tokens, known tokens and the unigram score; the number of training tokens."""
    tokens = {d: [*words(t, lower=True), None] for d, t in docs}
    counts = Counter(x for d in tokens if crc(key(d)) % 7 != 2 for x in tokens[d])
    total, distinct = sum(counts.values()), len(counts)
    score = {d: sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in ts) for d, ts in tokens.items()}
    return {d: (len(ts), sum(counts[x] > 0 for x in ts), score[d]) for d, ts in tokens.items()}, total


def interpolated_scores(docs, rounds=25, key=lambda d: d):
    """Scores by id of a bigram model whose every word has counts of its own, by its definition."""
    tokens = {d: [None, *words(t, lower=True), None] for d, t in docs}
    full, kept, pair, kept_pair, left = Counter(), Counter(), Counter(), Counter(), Counter()
    for d, ts in tokens.items():
        if crc(key(d)) % 7 == 2:
            continue
        both = list(zip(ts[:-1], ts[1:], strict=True))
        full.update(ts[1:])
        pair.update(both)
        if crc(key(d)) % 7 == 3:
            left.update(both)
        else:
            kept.update(ts[1:])
            kept_pair.update(both)
    even, total, kept_total = 1 / (len(full) + 1), max(sum(full.values()), 1), max(sum(kept.values()), 1)
    weights = {b: [1 / 3] * 3 for b in range(64)} | {0: [0.5, 0.5, 0.0]}
    for _ in range(rounds):
        mass = {}
        for (v, w), times in left.items():
            shares = [even, kept[w] / kept_total, kept_pair[v, w] / kept[v] if kept[v] else 0.0]
            parts = [a * b for a, b in zip(weights[kept[v].bit_length()], shares, strict=True)]
            own = mass.setdefault(kept[v].bit_length(), [0.0] * 3)
            for k in range(3):
                own[k] += times * parts[k] / sum(parts)
        weights |= {b: [x / sum(m) for x in m] for b, m in mass.items()}
    scores = {}
    for d, ts in tokens.items():
        value = 0.0
        for v, w in zip(ts[:-1], ts[1:], strict=True):
            a, b, c = (max(x, least) for x, least in zip(weights[full[v].bit_length()], (1e-6, 0, 0), strict=True))
            a, b, c = (x / (a + b + c) for x in (a, b, c))
            bigram = pair[v, w] / full[v] if full[v] else 0.0
            value += math.log10((a if full[v] else a + c) * even + b * full[w] / total + c * bigram)
        scores[d] = value
    return scores


def targets(sizes, weights, share, ceiling):
    """Targets by source, by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        given = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, more in given.items():
            target[s] += more
            if target[s] >= ceiling * sizes[s]:
                left += target[s] - ceiling * sizes[s]
                target[s] = float(ceiling * sizes[s])
                free.discard(s)
    return target
