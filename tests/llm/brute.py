"""Plain versions of the operators' definitions, for small inputs."""

import hashlib
import math
from collections import Counter

import xxhash


def words(text):
    return (text or "").encode().split()


def top_k(rows, k, every):
    """rows: [(id, vector or None)] -> {query: [(rank, id, score)]}."""
    whole = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((i, [math.floor(256 * x) for x in v]))
    out = {}
    for q, a in whole:
        if q % every:
            continue
        got = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q)[:k]
        out.setdefault(q, [(r + 1, i, -s) for r, (s, i) in enumerate(got)])
    return out


def lm_scores(rows, targets, least):
    """rows: [(id, text)] -> [(n, score)]: bigrams interpolated (0.7) with add-one unigrams."""
    toks = [words(t) for _, t in rows]
    aimed = [i is not None and i in targets for i, _ in rows]
    first = Counter(w for t, a in zip(toks, aimed) if a for w in t)
    known = {w for w, n in first.items() if n >= least}
    seqs = [[w if w in known else None for w in t] for t in toks]

    def model(use):
        uni, bi, head = Counter(), Counter(), Counter()
        for s, u in zip(seqs, use):
            if u:
                uni.update(s)
                bi.update(zip(["<s>", *s[:-1]] if s else [], s))
        for (h, _), n in bi.items():
            head[h] += n
        total = sum(uni.values())

        def p(h, w):
            one = (uni[w] + 1) / (total + len(known) + 1)
            return 0.7 * bi[h, w] / head[h] + 0.3 * one if head[h] else one
        return p
    target, every = model(aimed), model([True] * len(rows))
    out = []
    for s in seqs:
        d = [math.log(every(h, w)) - math.log(target(h, w)) for h, w in zip(["<s>", *s[:-1]], s)]
        out.append((len(s), sum(d) / len(d) if d else None))
    return out


def ordinal_features(text, bits):
    """Feature numbers of a text: words, four-byte stems of longer words, sixteen copies of each shape word."""
    raw = (text or "").encode()
    bare = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in raw.lower())
    told = bare.split()
    n, size = max(len(told), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shape = {"sym": min(8, 8 * sum(b in b"#*$%&|<>!" for b in raw) / n), "cap": 10 * sum(65 <= b <= 90 for b in raw) / size,
             "dis": 10 * len(set(told)) / n, "dup": 10 * (1 - len(set(lines)) / max(len(lines), 1)), "len": min(24, 2 * len(raw) / n)}
    marks = [f"\0{name}{int(x)}" for name, x in shape.items()] + ["\0bias"]
    names = set(told) | {b"^" + w[:4] for w in told if len(w) > 4} | {f"{m}#{k}".encode() for m in marks for k in range(16)}
    return names_to_numbers(names, bits)


def names_to_numbers(names, bits):
    return [xxhash.xxh64_intdigest(x, 11) % 2 ** bits for x in names]


def ordinal(text, weights, thresholds):
    """(expected grade, [P(grade > k) for each threshold k]) by P(grade <= k) = 1 / (1 + exp(margin - threshold_k))."""
    margin = sum(float(weights[f]) for f in ordinal_features(text, int(math.log2(len(weights)))))
    above = [1 - 1 / (1 + math.exp(margin - t)) for t in thresholds]
    return sum(above), above


def ordinal_loss(graded, weights, thresholds, l2):
    """Mean negative log-likelihood of (text, grade) rows, a feature counted once a text, with the quadratic penalty."""
    bits, total = int(math.log2(len(weights))), 0.0
    for text, grade in graded:
        margin = sum(float(weights[f]) for f in set(ordinal_features(text, bits)))
        upto = [0.0, *(1 / (1 + math.exp(margin - t)) for t in thresholds), 1.0]
        total -= math.log(upto[grade + 1] - upto[grade])
    return total / len(graded) + l2 / 2 * sum(float(w) ** 2 for w in weights if w)


def simhash(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=2):
    """Union-find over all pairs of fingerprints -> root index of each row."""
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def word_windows(rows, size):
    """rows: [(id, text)] -> [(n_words, n_removed, kept)], null ids last."""
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - size + 1):
            s = tuple(w[p:p + size])
            least[s] = min(least.get(s, math.inf), key(i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if least[tuple(w[p:p + size])] < key(i):
                gone[p:p + size] = [True] * size
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def byte_windows(texts, size):
    """texts -> [(n_bytes, n_removed, n_spans, kept)]."""
    raw = [(t or "").encode() for t in texts]
    n = Counter(t[p:p + size] for t in raw for p in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for p in range(len(t) - size + 1):
            if n[t[p:p + size]] > 1:
                gone[p:p + size] = [True] * size
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()
