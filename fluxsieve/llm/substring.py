"""Substring dedup by difference-cover anchors (operator 8).

A window is ``window`` consecutive words of one document.  Every word covered by a window
whose word sequence also starts in a document with a smaller id is removed; windows are
judged on the input.

Method.  ``COVER`` is a difference cover modulo ``PERIOD``: for any two positions there is a
shift below ``PERIOD`` after which both are cover positions.  Only the anchors, runs of
``window - PERIOD + 1`` words starting at cover positions, are hashed; two equal windows
always share an anchor at the same place inside them.

1. batches send their distinct anchor hashes; buckets flag those found in two documents;
2. around each flagged anchor the batch *extends*: it hashes (128 bits) the full windows that
   contain it and sends each distinct one with the smallest id that has it; buckets answer
   whether a smaller id has it elsewhere;
3. the batch marks the covered words and emits what is left.

No pairs are formed: a passage shared by any number of documents is one entry per batch.

Defined results: a null or empty text has no words and keeps the empty string; a null id
sorts after all ids (such a document loses words to identified ones, never the reverse);
documents with the same id do not remove each other's words; repeated rows each get a result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from . import common as C

#: Perfect difference set: every residue modulo 7 is a difference of two of these (fixed values).
PERIOD, COVER = 7, (0, 1, 3)


def _anchors(texts, cache, window):
    """Word hashes, layout, anchor positions and anchor hashes of one batch."""
    h, counts = C.word_hashes(texts, cache)
    starts, owner = C.layout(counts)
    length = window - PERIOD + 1
    at = C.windows(h, length, 0x9E3779B97F4A7C15)
    if len(at):
        own = owner[:len(at)]
        inside = np.arange(len(at)) - starts[own]
        ok = np.isin(inside % PERIOD, COVER) & (inside + length <= counts[own]) & (counts[own] >= window)
        pos = np.flatnonzero(ok)
    else:
        pos = np.zeros(0, np.int64)
    return h, counts, starts, owner, pos, at[pos]


def _sorted_anchors(hashes, pos):
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    first = C.run_starts(s)
    return order, s, first


def _candidates(h, counts, starts, owner, pos, shared, window):
    """Window starts that contain a shared anchor at one of the first ``PERIOD`` places."""
    p = pos[shared]
    own = owner[p]
    lo = np.maximum(p - (PERIOD - 1), starts[own])
    hi = np.minimum(p, starts[own] + counts[own] - window)
    ok = hi >= lo
    delta = np.zeros(len(h) + 1, np.int64)
    np.add.at(delta, lo[ok], 1)
    np.add.at(delta, hi[ok] + 1, -1)
    return np.flatnonzero(np.cumsum(delta[:-1]) > 0)


def _window_hashes(h, starts_at, window):
    a = C.windows(h, window, 0xD6E8FEB86659FD93)[starts_at]
    b = C.windows(C.mix(h + np.uint64(0x632BE59BD9B4E019)), window, 0xA0761D6478BD642F)[starts_at]
    return a, b


def _distinct_windows(a, b):
    """Sorted order of window hashes, the first row of each run, and each row's run."""
    order = np.lexsort((b, a))          # stable: rows of a run stay in id order
    first = C.run_starts(a[order], b[order])
    run = np.zeros(len(a), np.int64)
    if len(a):
        run[first[1:]] = 1
        run = np.cumsum(run)
    return order, first, run


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13,
                    carry=(), batch_bytes: int = C.BATCH_BYTES) -> DataFrame:
    """Carried columns (default the id) with ``n_words, n_removed, kept_text``."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be longer than the cover's period ({PERIOD})")
    ship_package(docs.sparkSession)
    n = C.group_count(docs, text_col, batch_bytes)
    left = C.batched(docs, n, id_col, text_col, carry)

    def send_anchors(key, table):
        _, ids, texts = C.rows_in_order(table)
        h, counts, starts, owner, pos, hashes = _anchors(texts, C.WordHash(), window)
        order, s, first = _sorted_anchors(hashes, pos)
        last = np.append(first[1:], len(s)) - 1 if len(s) else first
        doc = ids[owner[pos[order]]]
        several = doc[first] != doc[last]
        return C.messages(C.ask(s[first], n, key[0].as_py(), 1, several.view(np.uint8)))

    def flag_shared(key, table):
        got = [(src, *C.unpack(x, np.uint64, np.uint8)) for _, src, x in C.inbox(table)]
        return C.messages([(src, key[0].as_py(), 1, C.pack(f)) for src, f in
                           _repeated([g[0] for g in got], [g[1] for g in got], [g[2] for g in got])])

    def send_windows(key, docs_t, answers):
        if not docs_t.num_rows:
            return C.messages([])
        _, ids, texts = C.rows_in_order(docs_t)
        parts, cand = _extend(texts, answers, window)
        h, owner = parts[0], parts[3]
        a, b = _window_hashes(h, cand, window)
        order, first, _ = _distinct_windows(a, b)
        pick = order[first]
        return C.messages(C.ask(a[pick], n, key[0].as_py(), 2, b[pick], ids[owner[cand[pick]]]))

    def find_smaller(key, table):
        got = [(src, *C.unpack(x, np.uint64, np.uint64, np.int64)) for _, src, x in C.inbox(table)]
        a, b, d = (np.concatenate([g[i] for g in got]) for i in (1, 2, 3))
        order = np.lexsort((d, b, a))
        first = C.run_starts(a[order], b[order])
        size = np.diff(np.append(first, len(a)))
        least = np.empty(len(a), np.int64)
        least[order] = np.repeat(d[order][first], size)
        out, at = [], 0
        for g in got:
            m = len(g[1])
            out.append((g[0], key[0].as_py(), 2, C.pack(least[at:at + m])))
            at += m
        return C.messages(out)

    def remove(key, docs_t, answers):
        table, ids, texts = C.rows_in_order(docs_t)
        (h, counts, starts, owner, _, _), cand = _extend(texts, answers, window)
        a, b = _window_hashes(h, cand, window)
        order, first, run = _distinct_windows(a, b)
        least = C.replies(answers, 2, np.int64)
        gone = np.zeros(len(h) + 1, np.int64)
        if len(order):
            hit = cand[order][ids[owner[cand[order]]] > least[run]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        kept, removed = [], []
        for i, t in enumerate(texts):
            g = gone[starts[i]:starts[i + 1]]
            removed.append(int(g.sum()))
            w = t.split()
            kept.append(b" ".join(w) if not removed[-1] else b" ".join([x for x, r in zip(w, g.tolist()) if not r]))
        return C.result(table, n_words=pa.array(counts, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                        kept_text=pa.array(kept, pa.binary()))

    asked = left.groupBy("batch").applyInArrow(send_anchors, C.MSG)
    flags = asked.groupBy("dest").applyInArrow(flag_shared, C.MSG)
    sent = left.groupBy("batch").cogroup(flags.groupBy("dest")).applyInArrow(send_windows, C.MSG)
    least = sent.groupBy("dest").applyInArrow(find_smaller, C.MSG)
    out = left.groupBy("batch").cogroup(flags.unionAll(least).groupBy("dest")).applyInArrow(
        remove, C.out_schema(left, "n_words bigint, n_removed bigint, kept_text binary"))
    return C.with_carried(out, carry, id_col)


def _repeated(srcs, hashes, several):
    """Per sender: 1 where its hash came from two senders or was already repeated at one."""
    allh, alls = np.concatenate(hashes), np.concatenate(several).astype(bool)
    order = np.argsort(allh, kind="stable")
    first = C.run_starts(allh[order])
    size = np.diff(np.append(first, len(allh)))
    again = (size > 1) | (np.add.reduceat(alls[order].astype(np.int64), first) > 0)
    flag = np.empty(len(allh), np.uint8)
    flag[order] = np.repeat(again, size)
    at = np.cumsum([0, *map(len, hashes)])
    return [(s, flag[at[i]:at[i + 1]]) for i, s in enumerate(srcs)]


def _extend(texts, answers, window):
    """Recompute a batch's anchors and turn the flagged ones into candidate window starts."""
    parts = _anchors(texts, C.WordHash(), window)
    h, counts, starts, owner, pos, hashes = parts
    order, s, first = _sorted_anchors(hashes, pos)
    flags = C.replies(answers, 1, np.uint8).astype(bool)
    shared = np.zeros(len(pos), bool)
    if len(pos):
        shared[order] = np.repeat(flags, np.diff(np.append(first, len(s))))
    return parts, _candidates(h, counts, starts, owner, pos, shared, window)


def digest(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()


#: The ``op8`` query in DuckDB SQL.
SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, i, w[i:i + 12] AS win FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS least FROM wins) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
marked AS (SELECT t.doc_id, t.i, t.word, coalesce(max(h.i) OVER (PARTITION BY t.doc_id ORDER BY t.i), -99) > t.i - 13 AS gone
           FROM words t LEFT JOIN hits h ON h.doc_id = t.doc_id AND h.i = t.i),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(kept.n, 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
