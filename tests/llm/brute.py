"""Plain versions of the operators, a document at a time, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def secret_base(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def squeezed(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def equal_groups(rows):
    """doc_id -> (keep_id, group size) for (doc_id, text) rows with distinct ids."""
    groups = {}
    for i, text in rows:
        groups.setdefault(squeezed(text), []).append((-len(text or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def simhash(text):
    import xxhash

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    """id -> smallest id reachable over pairs of values within radius bits; values: id -> int."""
    ids = sorted(values)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and (values[a] ^ values[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:]))
    often = Counter(triples)
    covered = {k + d for k, t in enumerate(triples) if often[t] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), failed)


def targets(sizes, weights=(1, 2, 3)):
    """source -> target words, by filling up the sources in turn."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    held, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return {**held, **share}
        for s in above:
            held[s] = float(3 * sizes[s])
            left -= 3 * sizes[s]


def highest_quotients(votes, seats, most):
    """Seats of each key, one at a time to the highest votes / (2 seats + 1); earlier keys win ties."""
    got = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max((k for k in votes if got[k] < most[k]), key=lambda k: votes[k] / (2 * got[k] + 1))
        got[best] += 1
    return got


def crc(data):
    return zlib.crc32(data)


def sha(data):
    return hashlib.sha256(data).hexdigest()
