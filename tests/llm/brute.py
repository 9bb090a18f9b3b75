"""Plain versions of operators, by loops over dicts and lists."""

import math
import re
import unicodedata


def brute_cosines(text, model, dimensions):
    """The cosine of a text with each centroid, and its letters."""
    counts, letters = {}, 0
    folded = []
    for c in text or "":
        letter = unicodedata.category(c)[0] == "L"
        letters += letter
        low = c.lower() if letter else " "
        folded.append(ord(low) if len(low) == 1 else ord(c))
    if not letters:
        return [], 0
    chars = [0x20, 0x20, *folded, 0x20]
    mask = 2**32 - 1
    for i in range(2, len(chars)):
        one = chars[i] * 0x9E3779B1 & mask
        two = one ^ (chars[i - 1] * 0x85EBCA6B + 0x165667B1 & mask)
        three = two ^ ((chars[i - 2] * 0xC2B2AE35 & mask) + 0x27D4EB2F & mask)
        word = chars[i] != 0x20
        for gram, used in ((one, word), (two, word or chars[i - 1] != 0x20), (three, word or chars[i - 1] != 0x20)):
            if used:
                slot = (gram * 0x2C1B3C6D & mask) >> 18
                counts[slot] = counts.get(slot, 0) + 1
    assert max(counts) < dimensions
    vector = {k: math.log(1 + n) * model.idf[k] for k, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in vector.values()))
    return [sum(x * float(c[k]) for k, x in vector.items()) / norm for c in model.centroids], letters


def brute_random(text, ratios, scan):
    """Spans of the best stretch of each run that passes."""
    out = []
    for m in re.finditer(scan.RUN, text or ""):
        total, begin, best, where, before = 0.0, 0, 0.0, (0, 0), None
        for i, c in enumerate(m[0]):
            if before is not None:
                total += ratios[scan.ALPHABET.index(before) * len(scan.ALPHABET) + scan.ALPHABET.index(c)]
            if total < 0:
                total, begin = 0.0, i
            if total > best and i + 1 - begin >= scan.MARKOV_LEAST:
                best, where = total, (begin, i + 1)
            before = c
        part = m[0][where[0] : where[1]]
        if best > scan.BOUND and re.search("[0-9]", part) and re.search("[A-Za-z]", part):
            out.append((m.start() + where[0], m.start() + where[1]))
    return out


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute_join(rows):
    """(doc_id, size of the set, smallest doc_id of its class, links, number of the class) of each row."""
    sets = [shingle_set(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(key, len(sets[i]), least.get(find(i)), links[i], find(i)) for i, (key, _) in enumerate(rows)]


def brute_isotonic(y):
    """By the formula of largest least means."""
    n = len(y)
    mean = {(j, k): sum(y[j : k + 1]) / (k + 1 - j) for j in range(n) for k in range(j, n)}
    return [max(min(mean[j, k] for k in range(i, n)) for j in range(i + 1)) for i in range(n)]


def brute_features(text, odds, toxicity):
    words = text.lower().split()
    if not text:
        return [0.0] * len(toxicity.NAMES)
    told = []
    for w in words:
        core, hidden = toxicity.plain(w)
        whole = odds.get(core, 0.0) if core else 0.0
        stem = max([odds.get(core[:k] + "*", 0.0) for k in toxicity.STEMS if len(core) > k], default=0.0)
        told.append((whole, stem, hidden, core in toxicity.SECOND_PERSON and bool(core)))
    n = max(1, len(words))
    hit = [bool(a or b) for a, b, _, _ in told]
    you = [i for i, x in enumerate(told) if x[3]]
    near = sum(any(abs(i - j) <= toxicity.NEAR + 1 for j in you) for i in range(len(words)) if hit[i])
    raw = text.encode()
    chars = max(1, len(text))
    upper, lower, digits = (sum(a <= c <= b for c in raw) for a, b in (b"AZ", b"az", b"09"))
    letters = max(1, upper + lower)
    marks = sum(33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in raw)
    repeats = sum(raw[i] == raw[i + 1] == raw[i + 2] for i in range(len(raw) - 2))
    hits = sum(hit)
    return [
        sum(x[0] > 0 for x in told) / n, sum(x[1] > 0 for x in told) / n, sum(max(x[:2]) for x in told) / n, max([0.0, *(max(x[:2]) for x in told)]),
        math.log(1 + hits), math.log(1 + len({w for w, h in zip(words, hit, strict=True) if h})), near / max(1.0, hits), near / n, len(you) / n,
        math.log(1 + sum(h and x[2] for h, x in zip(hit, told, strict=True))), sum(x[2] for x in told) / n, upper / letters, float(upper > 0.8 * letters),
        raw.count(b"!") / chars, raw.count(b"?") / chars, marks / chars, digits / chars, repeats / chars, math.log(1 + len(words)),
    ]
