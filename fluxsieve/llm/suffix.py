"""Suffix-array dedup (operator 10).

Every byte covered by a ``length``-byte string that also starts anywhere else, in the same
document or another one, is removed; matches never cross documents, overlaps count and all
strings are judged on the input.

1. **Anchors.**  In every ``length``-byte window the position with the least 64-byte hash is an
   anchor, so equal windows share an anchor at the same place.  An anchor's *context* holds all
   windows around it.  Batches send distinct (anchor hash, context hash) pairs; buckets answer
   which contexts occur twice as a whole (all of it is repeated) and which share their anchor
   with a *different* context (only part may be repeated).
2. **Suffix sorting.**  For the latter, one holder of each context sends its bytes to the shard
   of the anchor.  A shard sorts the suffixes of its text in two stages: suffixes smaller than
   their successor are sorted directly, the others are induced by scanning the buckets of first
   bytes in order.  Neighbours in that order whose common prefix reaches ``length`` are
   repeated.
3. **Single windows.**  An anchor with very many different contexts (a passage that goes on
   differently in each of its documents) sends no bytes: each distinct window around it is counted
   at the bucket of its own 128-bit hash, so windows inside the passage are one entry per batch and
   those over its edges are spread by their own bytes.  A batch that holds ``MANY`` contexts of an
   anchor itself says so in one entry, in place of listing them.
4. The batch merges all three kinds of spans and cuts them out.

No pairs are formed.  A passage with any number of copies is one entry per batch at most, an anchor
fewer than ``MANY``, and a shard gets the bytes of fewer than ``CROWD`` contexts of one anchor.

Defined results: null and empty texts have no bytes and no spans; documents are rows, so
repeated rows are copies of each other whatever their ids; null ids are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from . import common as C

GRAM = 64
#: Bytes of text in a batch: a batch works on some ten 64-bit columns over its bytes.
BATCH_BYTES = 2 << 20
#: Contexts of one anchor from which its windows are counted one by one: in all batches, in one batch.
CROWD, MANY = 256, 16

_TABLE = C.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95


# ------------------------------------------------------------------ anchors

def _gram_hashes(flat: np.ndarray) -> np.ndarray:
    """Nonzero hash of the ``GRAM`` bytes from each position (by doubling)."""
    h, b, span = _TABLE[flat], _BASE, 1
    while span < GRAM:
        m = max(0, len(h) - span)
        h = h[:m] * np.uint64(b) + h[span:span + m]
        b, span = (b * b) & 0xFFFFFFFFFFFFFFFF, span * 2
    return C.mix(h) | np.uint64(1)


def _sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each run of ``width`` elements, by doubling."""
    acc, span = x, 1
    while span * 2 <= width:
        acc = op(acc[:-span], acc[span:])
        span *= 2
    rest = width - span
    return op(acc[:len(acc) - rest], acc[rest:]) if rest else acc


class _Text:
    """The documents of a batch as one byte array, with anchors and their contexts."""

    def __init__(self, texts, length):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.length = length
        n, w = len(self.flat), length - GRAM + 1
        if n < length:
            self.pos = np.zeros(0, np.int64)
            self.h = self.hash = self.context = self.least = np.zeros(0, np.uint64)
            self.lo = self.hi = self.owner = self.pos
            return
        h = _gram_hashes(self.flat)
        least = _sliding(np.minimum, h, w)                  # per window start
        valid = np.zeros(n + 1, np.int32)                   # window starts that stay inside a document
        long = self.sizes >= length
        np.add.at(valid, self.starts[:-1][long], 1)
        np.add.at(valid, self.starts[1:][long] - length + 1, -1)
        least = np.where(np.cumsum(valid[:len(least)]) > 0, least, np.uint64(0))
        self.least = least
        pad = np.zeros(w - 1, np.uint64)
        best = _sliding(np.maximum, np.concatenate([pad, least, pad]), w)   # over the windows holding a position
        self.pos = np.flatnonzero(best[:len(h)] == h)
        self.h = h
        self.hash = C.mix(h[self.pos])                      # anchors have the least hashes: spread them over the buckets again
        self.owner = np.searchsorted(self.starts, self.pos, "right") - 1
        self.lo = np.maximum(self.pos - (length - GRAM), self.starts[self.owner])
        self.hi = np.minimum(self.pos + length, self.starts[self.owner + 1])
        self.context = self.span_hash(self.lo, self.hi, self.pos - self.lo) | np.uint64(1)   # 0 stands for many

    def span_hash(self, lo, hi, seed) -> np.ndarray:
        """Hash of the bytes of each span (at least ``GRAM`` long) and of ``seed``, from its gram hashes."""
        acc = C.mix(seed.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + (hi - lo).astype(np.uint64))
        steps = int((hi - lo).max() // GRAM + 1) if len(lo) else 0
        for k in range(steps):
            at = np.minimum(lo + k * GRAM, hi - GRAM)
            acc = np.where(lo + k * GRAM < hi, C.mix(acc * np.uint64(_BASE) + self.h[at]), acc)
        return acc

    def classes(self):
        """Anchors ordered by (hash, context) with the first of each distinct pair."""
        order = np.lexsort((self.context, self.hash))
        first = C.run_starts(self.hash[order], self.context[order])
        return order, first


#: What a batch says of an (anchor, context): it holds it once; several times; it holds many contexts of the anchor.
ONCE, SEVERAL, CROWDED = 0, 1, 2


def _entries(t: _Text):
    """``(pick, several, listed, sent)``: an anchor of each distinct (anchor, context) and whether there are
    several; whether the pair is listed; the pairs that are entries (of an anchor not listed the first)."""
    order, first = t.classes()
    several = np.diff(np.append(first, len(order))) > 1
    pick = order[first]
    anchor = C.run_starts(t.hash[pick])
    kinds = np.diff(np.append(anchor, len(pick)))
    listed = np.repeat(kinds < MANY, kinds)
    entry = listed.copy()
    entry[anchor] = True
    return pick, several, listed, np.flatnonzero(entry)


def _send_anchors(texts, n, src, length):
    t = _Text(texts, length)
    pick, several, listed, sent = _entries(t)
    context = np.where(listed, t.context[pick], np.uint64(0))[sent]
    state = np.where(listed, np.where(several, SEVERAL, ONCE), CROWDED)[sent].astype(np.uint8)
    return C.ask(t.hash[pick[sent]], n, src, 1, context, state)


#: What a bucket answers for a batch's (anchor, context): the context is repeated as a whole; this
#: batch sends it; it belongs to a crowded anchor, whose windows are counted one by one.
WHOLE, SEND, SPLIT = 1, 2, 4


def _judge(got, bucket, crowd):
    h, c, state = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
    order = np.lexsort((c, h))                              # stable: senders in order within a pair
    hs, cs, state = h[order], c[order], state[order]
    pair = C.run_starts(hs, cs)
    size = np.diff(np.append(pair, len(hs)))
    whole = (size > 1) | (np.maximum.reduceat(state, pair) == SEVERAL)
    anchor = C.run_starts(hs[pair])
    per_anchor = np.diff(np.append(anchor, len(pair)))
    many = np.maximum.reduceat(np.maximum.reduceat(state, pair), anchor) == CROWDED
    kinds, split = np.repeat(per_anchor, per_anchor), np.repeat(many | (per_anchor >= crowd), per_anchor)
    flag = np.repeat(np.where(whole, WHOLE, 0) + np.where(split, SPLIT, 0), size)
    flag[pair[kinds > 1]] += SEND
    out = np.empty(len(h), np.uint8)
    out[order] = flag
    return _answers(got, bucket, 1, out)


def _answers(got, bucket, kind, out):
    """``out``, which goes with the joined columns of all senders, as one message to each."""
    at = np.cumsum([0, *[len(g[1]) for g in got]])
    return [(g[0], bucket, kind, C.pack(out[at[i]:at[i + 1]])) for i, g in enumerate(got)]


def _flags(t: _Text, answers):
    """``(pick, flags)`` of each distinct (anchor, context), from the answers to the entries."""
    pick, several, listed, sent = _entries(t)
    flags = np.where(several, WHOLE | SEND | SPLIT, SEND | SPLIT).astype(np.uint8)   # not listed: the batch knows
    own = listed[sent]
    flags[sent[own]] = answers[own]
    return pick, flags


# ------------------------------------------------------------------ single windows

def _windows(t: _Text, pick, flags, length):
    """Windows in the contexts sent for crowded anchors, each with the anchor of least hash in it:
    ``(start, first, hash, second hash, several)``, starts in the order of the hashes, the others per distinct window."""
    crowd = t.pos[pick[(flags & (SEND | SPLIT)) == (SEND | SPLIT)]]
    back = np.arange(length - GRAM + 1)
    taken = np.zeros(len(t.least), bool)
    for i in range(0, len(crowd), 4096):                    # bounded working memory
        p = crowd[i:i + 4096, None]
        s = np.clip(p - back, 0, len(taken) - 1)
        taken[s[t.least[s] == t.h[p]]] = True               # windows that leave their document have 0
    start = np.flatnonzero(taken)
    one = t.span_hash(start, start + length, np.zeros(len(start), np.int64))
    two = np.zeros(len(start), np.uint64)
    if len(start):
        word = np.lib.stride_tricks.sliding_window_view(t.flat, 8)
        for off in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
            two = C.mix(two * np.uint64(_BASE) + word[start + off].view(np.uint64).ravel() + np.uint64(1))
    order = np.lexsort((two, one))
    start, one, two = start[order], one[order], two[order]
    first = C.run_starts(one, two)
    return start, first, one[first], two[first], np.diff(np.append(first, len(start))) > 1


def _count_windows(got, bucket):
    """Answers per batch: whether each window occurs again, there or elsewhere."""
    one, two, several = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
    order = np.lexsort((two, one))
    first = C.run_starts(one[order], two[order])
    size = np.diff(np.append(first, len(order)))
    out = np.empty(len(one), np.uint8)
    out[order] = np.repeat((size > 1) | (np.maximum.reduceat(several[order], first) > 0), size)
    return _answers(got, bucket, 3, out)


# ------------------------------------------------------------------ shards

def _pieces(t: _Text, pick, flags, shards):
    """Spans of this batch for each shard: (shard, lo, hi)."""
    plain = pick[(flags & (SEND | SPLIT)) == SEND]
    shard, lo, hi = (C.mix(t.hash[plain]) % np.uint64(shards)).astype(np.int64), t.lo[plain], t.hi[plain]
    order = np.lexsort((hi, lo, shard))
    return shard[order], lo[order], hi[order]


def merged(owner, lo, hi):
    """Union of the spans (sorted by owner and start) of each owner."""
    if not len(lo):
        return owner, lo, hi
    top = hi.copy()
    base = np.int64(max(int(hi.max()), 0) + 1)
    rank = np.cumsum(np.concatenate([[0], (owner[1:] != owner[:-1]).astype(np.int64)]))
    top = np.maximum.accumulate(top + rank * base) - rank * base
    new = np.ones(len(lo), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (lo[1:] > top[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(lo)) - 1
    return owner[first], lo[first], top[last]


def _send_pieces(t: _Text, answers, length, shards, src):
    """Bytes for the shards (kind 2) and windows for the buckets (kind 3)."""
    pick, flags = _flags(t, answers)
    _, _, one, two, several = _windows(t, pick, flags, length)
    shard, lo, hi = _pieces(t, pick, flags, shards)
    owner = np.searchsorted(t.starts, lo, "right") - 1
    group, lo, hi = merged(shard * (len(t.sizes) + 1) + owner, lo, hi)
    shard = group // (len(t.sizes) + 1)
    out = C.ask(one, shards, src, 3, two, several.view(np.uint8))
    cut = np.append(C.run_starts(shard), len(shard))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        body = b"".join(t.flat[x:y].tobytes() for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist()))
        out.append((int(shard[a]), src, 2, C.pack(lo[a:b], (hi - lo)[a:b], body)))
    return out


def _types(x: np.ndarray, ends: np.ndarray):
    """``(small, last)``: suffix smaller than its successor (type B); last position of its piece."""
    n = len(x)
    last = np.arange(1, n + 1) == ends                    # the empty suffix follows: smaller than any
    step = np.append(x[1:], np.uint8(0)).astype(np.int16) - x
    step[last] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]            # next place where the byte changes
    return step[at] > 0, last


def _sort_directly(text: bytes, at: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes: by two 8-byte words, then tie by tie."""
    if len(at) < 2:
        return at
    raw = np.frombuffer(text + bytes(16), np.uint8)
    word = np.lib.stride_tricks.sliding_window_view(raw, 8)
    keys = [word[at].copy(), word[at + 8].copy()]
    for i in np.flatnonzero(ends[at] - at < 16).tolist():  # nothing of the next piece
        own = text[at[i]:ends[at[i]]].ljust(16, b"\0")
        keys[0][i], keys[1][i] = np.frombuffer(own[:8], np.uint8), np.frombuffer(own[8:], np.uint8)
    k1, k2 = (k.view(">u8").ravel().astype(np.uint64) for k in keys)
    order = np.lexsort((k2, k1))
    at, k1, k2 = at[order], k1[order], k2[order]
    first = C.run_starts(k1, k2)
    size = np.diff(np.append(first, len(at)))
    tied = np.flatnonzero(size > 1)
    stop = np.minimum(at + depth, ends[at]).tolist()
    for lo, hi in zip(first[tied].tolist(), (first + size)[tied].tolist()):
        own = at[lo:hi].tolist()
        cut = [text[i:j] for i, j in zip(own, stop[lo:hi])]
        at[lo:hi] = [own[k] for k in sorted(range(len(own)), key=cut.__getitem__)]
    return at


def sort_suffixes(text: bytes, ends: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions of ``text`` in the order of the suffixes' first ``depth`` bytes.

    ``ends[i]`` is where position i's piece ends; a suffix stops there, and a shorter one
    comes before those it is a prefix of.  Two stages: type B suffixes (smaller than their
    successor) are sorted directly; type A suffixes are placed by scanning the buckets of first
    bytes in order, each placed suffix putting its predecessor, if that is type A, into the front
    part of the predecessor's bucket.  With ``wanted`` only those positions, and the successors
    that type A ones among them are induced from, are sorted.
    """
    n = len(text)
    x = np.frombuffer(text, np.uint8)
    small, last = _types(x, ends)
    keep = np.ones(n, bool)
    if wanted is not None:
        # a position is needed if wanted, or if the type A suffix before it in its piece is needed
        chain = np.cumsum(small | last)                   # number of the A...AB stretch, counted at its end
        stretch = np.concatenate([[0], chain[:-1]]) if n else chain
        begin = np.where(wanted, np.arange(n), n)
        least = np.full(int(stretch[-1]) + 1 if n else 0, n)
        np.minimum.at(least, stretch[wanted], begin[wanted])
        keep = np.arange(n) >= least[stretch] if n else keep
    direct = _sort_directly(text, np.flatnonzero(small & keep), ends, depth)
    edge = np.searchsorted(x[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    ended = np.flatnonzero(last & keep)                   # their successor is the empty suffix, the least of all
    ended = ended[np.argsort(x[ended], kind="stable")]
    ended_at = np.searchsorted(x[ended], np.arange(257))
    induced = ~small & ~last & keep                       # what a placed successor places
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def place(placed: np.ndarray, c: int) -> np.ndarray:
        """Append to the order; hand predecessors on to later buckets; return those of this bucket."""
        out.append(placed)
        p = placed[placed > 0] - 1
        p = p[induced[p]]
        here = p[x[p] == c]
        p = p[x[p] > c]
        if len(p):
            p = p[np.argsort(x[p], kind="stable")]
            cut = np.append(C.run_starts(x[p]), len(p)).tolist()
            for a, b in zip(cut[:-1], cut[1:]):
                waiting[int(x[p[a]])].append(p[a:b])
        return here

    for c in range(256):
        front = np.concatenate([ended[ended_at[c]:ended_at[c + 1]], *waiting[c]])
        while len(front):                                 # runs of one byte: each round induces the next
            front = place(front, c)
        if edge[c + 1] > edge[c]:
            place(direct[edge[c]:edge[c + 1]], c)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeated_positions(text: bytes, ends: np.ndarray, length: int) -> np.ndarray:
    """Positions whose next ``length`` bytes also start elsewhere in ``text``: neighbours in suffix
    order with a common prefix of at least that."""
    full = ends - np.arange(len(text)) >= length
    order = sort_suffixes(text, ends, length, full)
    order = order[full[order]]
    a, b = order[:-1], order[1:]
    raw = np.frombuffer(text + bytes(8), np.uint8)
    word = np.lib.stride_tricks.sliding_window_view(raw, 8)
    alive = np.arange(len(a))
    whole, rest = divmod(length, 8)
    for off in [*range(0, whole * 8, 8), *([length - 8] if rest else [])]:
        same = np.empty(len(alive), bool)
        for s in range(0, len(alive), 1 << 18):           # bounded working memory
            t = alive[s:s + (1 << 18)]
            same[s:s + (1 << 18)] = word[a[t] + off].copy().view(np.uint64).ravel() == word[b[t] + off].copy().view(np.uint64).ravel()
        alive = alive[same]
        if not len(alive):
            break
    flag = np.zeros(len(text), bool)
    flag[a[alive]] = True
    flag[b[alive]] = True
    return np.flatnonzero(flag)


def _solve_shard(got, shard, length):
    """Answers per batch: spans of repeated strings, in the batch's byte positions."""
    if not got:
        return []
    srcs, los, sizes, bodies = [], [], [], []
    for src, lo, size, body in got:
        srcs.append(np.full(len(lo), src, np.int64))
        los.append(lo)
        sizes.append(size)
        bodies.append(body)
    src, lo, size = map(np.concatenate, (srcs, los, sizes))
    text = b"".join(bodies)
    edge = np.concatenate([[0], np.cumsum(size)])
    ends = np.repeat(edge[1:], size)
    hit = repeated_positions(text, ends, length)
    piece = np.searchsorted(edge, hit, "right") - 1
    begin = hit - edge[piece] + lo[piece]
    s, a, b = merged(src[piece] * (len(lo) + 1) + piece, begin, begin + length)
    s = s // (len(lo) + 1)
    cut = np.append(C.run_starts(s), len(s)).tolist()
    return [(int(s[i]), shard, 2, C.pack(a[i:j], b[i:j])) for i, j in zip(cut[:-1], cut[1:])]


# ------------------------------------------------------------------ the operator

def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200,
                    carry=(), batch_bytes: int = BATCH_BYTES, crowd: int = CROWD,
                    whole_characters: bool = False) -> DataFrame:
    """Carried columns (default the id) with ``n_bytes, n_removed, n_spans, kept`` (binary).

    With ``whole_characters`` a UTF-8 character of which a byte goes goes as a whole, so that
    ``kept`` is text again.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM} bytes")
    ship_package(docs.sparkSession)
    n = C.group_count(docs, text_col, batch_bytes)
    left = C.batched(docs, n, id_col, text_col, carry)

    def ask(key, table):
        _, _, texts = C.rows_in_order(table)
        return C.messages(_send_anchors(texts, n, key[0].as_py(), length))

    def judge(key, table):
        got = [(src, *C.unpack(x, np.uint64, np.uint64, np.uint8)) for _, src, x in C.inbox(table)]
        return C.messages(_judge(got, key[0].as_py(), crowd))

    def send(key, docs_t, answers):
        _, _, texts = C.rows_in_order(docs_t)
        return C.messages(_send_pieces(_Text(texts, length), C.replies(answers, 1, np.uint8), length, n, key[0].as_py()))

    def solve(key, table):
        got = [(src, *C.unpack(x, np.int64, np.int64, None)) for _, src, x in C.inbox(table, 2)]
        windows = [(src, *C.unpack(x, np.uint64, np.uint64, np.uint8)) for _, src, x in C.inbox(table, 3)]
        bucket = key[0].as_py()
        return C.messages(_solve_shard(got, bucket, length) + (_count_windows(windows, bucket) if windows else []))

    def cut(key, docs_t, answers):
        table, _, texts = C.rows_in_order(docs_t)
        t = _Text(texts, length)
        order, first = t.classes()
        pick, flags = _flags(t, C.replies(answers, 1, np.uint8))
        whole = np.zeros(len(t.pos), bool)
        if len(order):
            whole[order] = np.repeat((flags & WHOLE) > 0, np.diff(np.append(first, len(order))))
        spans = [C.unpack(x, np.int64, np.int64) for _, _, x in C.inbox(answers, 2)]
        start, head = _windows(t, pick, flags, length)[:2]
        again = start[np.repeat(C.replies(answers, 3, np.uint8) > 0, np.diff(np.append(head, len(start))))]
        lo = np.concatenate([t.lo[whole], again, *[s[0] for s in spans]])
        hi = np.concatenate([t.hi[whole], again + length, *[s[1] for s in spans]])
        delta = np.zeros(len(t.flat) + 1, np.int64)
        np.add.at(delta, lo, 1)
        np.add.at(delta, hi, -1)
        gone = np.cumsum(delta[:-1]) > 0
        if whole_characters and gone.any():
            char = np.cumsum((t.flat & 0xC0) != 0x80)
            gone = (np.bincount(char, gone) > 0)[char]
        removed, n_spans, kept = [], [], []
        for i, x in enumerate(texts):
            g = gone[t.starts[i]:t.starts[i + 1]]
            k = int(g.sum())
            removed.append(k)
            n_spans.append(int(g[:1].sum()) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
            kept.append(x if not k else t.flat[t.starts[i]:t.starts[i + 1]][~g].tobytes())
        return C.result(table, n_bytes=pa.array(t.sizes, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                        n_spans=pa.array(n_spans, pa.int64()), kept=pa.array(kept, pa.binary()))

    flags = left.groupBy("batch").applyInArrow(ask, C.MSG).groupBy("dest").applyInArrow(judge, C.MSG)
    pieces = left.groupBy("batch").cogroup(flags.groupBy("dest")).applyInArrow(send, C.MSG)
    spans = pieces.groupBy("dest").applyInArrow(solve, C.MSG)
    out = left.groupBy("batch").cogroup(flags.unionAll(spans).groupBy("dest")).applyInArrow(
        cut, C.out_schema(left, "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))
    return C.with_carried(out, carry, id_col)
