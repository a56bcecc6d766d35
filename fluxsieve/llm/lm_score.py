"""Cross-entropy difference under matched n-gram models (operator 2).

Two bigram models, one of target documents and one of all documents, share vocabulary, order and
smoothing.  Each token's loss difference ``-log p_target + log p_background`` is averaged over
the document: the lower the score, the more the text resembles the target.

* Vocabulary: words that occur at least ``least_count`` times in the target documents; all others
  are one unknown word.
* ``p(w | h) = weight * c(h, w) / c(h) + (1 - weight) * p(w)`` (interpolation; ``p(w)`` alone after an h
  that the model has not seen) with ``p(w) = (c(w) + 1) / (N + V + 1)``; a document's first word follows
  a start mark.

Counts are exact and over the whole corpus.  They are gathered in two message rounds (see
``common``): batches send their distinct words with counts, word buckets answer which are in the
vocabulary and how often they occur and are followed; then batches send their distinct word pairs, and
the bucket of a *pair* answers its counts in both models.  A frequent word costs one entry per batch,
and since pairs are bucketed by both words, no word's pairs, not even the unknown word's, meet in one task.

Defined results: a text without words scores null; a null id is never a target; without target
documents all words are unknown and both models are fitted all the same; ids repeated in the
target list count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

#: Vocabulary numbers of unknown words and of the mark before a text; words are numbered from 2.
UNKNOWN, START = 0, 1


class _Words:
    """Words of a batch, with the distinct ones in hash order."""

    def __init__(self, table):
        is_target = [x is not None for x in table.column("target").to_pylist()]
        texts = table.column("text").to_pylist()
        ids = table.column("id").to_pylist()
        marked = {i for i, t in zip(ids, is_target) if t}
        rows = sorted((i for i, t in enumerate(is_target) if not t),
                      key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        self.table = table.take(pa.array(rows, pa.int64()))
        self.target = np.array([ids[i] is not None and ids[i] in marked for i in rows], bool)
        self.h, self.counts = C.word_hashes([texts[i] or b"" for i in rows], C.WordHash())
        self.starts, self.owner = C.layout(self.counts)
        self.words, self.which = np.unique(self.h, return_inverse=True)
        self.aimed = self.target[self.owner] if len(self.owner) else np.zeros(0, bool)

    def unigrams(self):
        """Per distinct word: occurrences and those that end a text, in all documents and in target documents."""
        last = np.zeros(len(self.which), bool)
        last[self.starts[1:][self.counts > 0] - 1] = True
        count = lambda rows: np.bincount(self.which[rows], minlength=len(self.words)).astype(np.int64)
        return count(slice(None)), count(self.aimed), count(last), count(last & self.aimed)

    def pairs(self, number, buckets):
        """The batch's distinct word pairs ordered by bucket, first and second word, and each token's first word and
        pair.  ``number``: vocabulary number of each distinct word."""
        w = number[self.which]
        before = np.empty_like(w)
        if len(w):
            before[1:] = w[:-1]
            before[self.starts[:-1][self.counts > 0]] = START
        key = C.mix(C.mix(before.astype(np.uint64)) + w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        bucket = C.bucket_of(key, buckets)
        order = np.lexsort((w, before, bucket))
        first = C.run_starts(bucket[order], before[order], w[order])
        run = np.zeros(len(w), np.int64)
        run[first[1:]] = 1
        pair = np.empty(len(w), np.int64)
        pair[order] = np.cumsum(run)
        pick = order[first]
        return bucket[pick], before[pick], w[pick], before, pair


def _grouped(columns, got):
    """Rows of all senders as equal-row groups: ``(group of each row, sums(column))``."""
    rows = [np.concatenate([g[i] for g in got]) for i in columns]
    order = np.lexsort(rows[::-1])
    first = C.run_starts(*[r[order] for r in rows])
    group = np.empty(len(rows[0]), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return group, lambda i: np.add.reduceat(np.concatenate([g[i] for g in got])[order], first)


def _count_words(got, bucket, buckets, least):
    """Vocabulary number (0 outside the vocabulary) and the four counts of every word a batch asked for, and, addressed
    to nobody (-1), this bucket's share of the totals: vocabulary, then each count over all words and over known ones."""
    group, sums = _grouped([1], got)
    counts = [sums(i) for i in (2, 3, 4, 5)]
    known = counts[1] >= least
    number = np.where(known, 2 + bucket + buckets * (np.cumsum(known) - 1), UNKNOWN)    # no other bucket gives it
    at = np.cumsum([0, *[len(g[1]) for g in got]])
    out = []
    for i, g in enumerate(got):
        w = group[at[i]:at[i + 1]]
        out.append((g[0], bucket, 1, C.pack(*[C.small(np.where(known, x, 0)[w]) for x in (number, *counts)])))
    totals = [known.sum(), *[x.sum() for x in counts], *[x[known].sum() for x in counts]]
    return [*out, (-1, bucket, 3, C.pack(np.array(totals, np.int64)))]


def _count_pairs(got, bucket):
    """Both counts of each pair a batch asked for, in its order."""
    group, sums = _grouped([1, 2], got)
    every, aimed = sums(3), sums(4)
    at = np.cumsum([0, *[len(g[1]) for g in got]])
    return [(g[0], bucket, 2, C.pack(C.small(every[group[at[i]:at[i + 1]]]), C.small(aimed[group[at[i]:at[i + 1]]])))
            for i, g in enumerate(got)]


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_count: int = 10,
          weight: float = 0.7, carry=(), batch_bytes: int = C.BATCH_BYTES) -> DataFrame:
    """Carried columns (default the id) with ``n_tokens`` and ``score``; ``targets`` has the ids of target documents."""
    ship_package(docs.sparkSession)
    n = C.group_count(docs, text_col, batch_bytes)
    mine = C.batched(docs, n, id_col, text_col, carry).withColumn("target", F.lit(None).cast("int"))
    doc_type = mine.schema["doc"].dataType.simpleString()
    ids = targets.select(F.col(id_col).cast("long").alias("id")).filter("id IS NOT NULL").distinct()
    marks = ids.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("batch"), "id", F.lit(None).cast("binary").alias("text"),
                       F.lit(None).cast(doc_type).alias("doc"), F.lit(1).alias("target"))
    left = mine.unionAll(marks)

    def ask_words(key, table):
        x = _Words(table)
        counts = x.unigrams()
        return C.messages([(b, key[0].as_py(), 1, C.pack(x.words[i:j], *[C.small(c[i:j]) for c in counts]))
                           for b, i, j in C.by_bucket(x.words, n)])

    def count_words(key, table):
        got = [(s, C.unpack(m, np.uint64, *[None] * 4)) for _, s, m in C.inbox(table)]
        return C.messages(_count_words([(s, h, *map(C.wide, c)) for s, (h, *c) in got], key[0].as_py(), n, least_count))

    def known_words(answers):
        got = [C.unpack(m, *[None] * 5) for _, _, m in C.inbox(answers, 1)]
        return [np.concatenate([np.zeros(0, np.int64), *[C.wide(g[i]) for g in got]]) for i in range(5)]

    def ask_pairs(key, table, answers):
        x = _Words(table)
        bucket, heads, words, _, pair = x.pairs(known_words(answers)[0], n)
        every = np.bincount(pair, minlength=len(words)).astype(np.int64)
        aimed = np.bincount(pair[x.aimed], minlength=len(words)).astype(np.int64)
        # first words rise within a message: their steps are small
        return C.messages([(b, key[0].as_py(), 2, C.pack(C.small(np.diff(heads[i:j], prepend=0)),
                                                         *[C.small(c[i:j]) for c in (words, every, aimed)]))
                           for b, i, j in C.runs(bucket)])

    def count_pairs(key, table):
        got = [(s, *map(C.wide, C.unpack(m, *[None] * 4))) for _, s, m in C.inbox(table)]
        return C.messages(_count_pairs([(s, np.cumsum(steps), *rest) for s, steps, *rest in got], key[0].as_py()))

    def add_up(key, table):
        sums = np.sum([C.unpack(m, np.int64)[0] for _, _, m in C.inbox(table)], axis=0)
        return C.messages([(-1, -1, 3, C.pack(sums.astype(np.int64)))])

    def per_token(key, table, answers):
        x = _Words(table)
        number, *counts = known_words(answers)
        _, _, _, before, pair = x.pairs(number, n)
        got = [C.unpack(m, np.int64)[0] for _, _, m in C.inbox(answers, 3)]      # none: there are no words at all
        vocabulary, total, known = (int(got[0][0]), got[0][1:5], got[0][5:9]) if got else (0, np.zeros(4), np.zeros(4))
        rest = total - known
        parts = [[C.wide(c) for c in C.unpack(m, None, None)] for _, _, m in C.inbox(answers, 2)]
        loss = np.zeros(len(pair))
        for sign, k in ((1, 0), (-1, 1)):                                        # background, target
            own, ends = np.where(number > 0, counts[k], rest[k]), np.where(number > 0, counts[k + 2], rest[k + 2])
            one = (own[x.which] + 1.0) / (total[k] + vocabulary + 1.0)
            # how often the first word is followed: it occurs and does not end the text; the start mark opens each text
            followed = np.empty(len(pair))
            if len(pair):
                followed[1:] = (own - ends)[x.which[:-1]]
                followed[before == START] = total[k + 2]
            c = np.concatenate([np.zeros(0, np.int64), *[p[k] for p in parts]])[pair]
            seen = followed > 0
            p = np.where(seen, weight * c / np.where(seen, followed, 1.0) + (1 - weight) * one, one)
            loss += sign * np.log(p)
        sums = np.concatenate([[0.0], np.cumsum(loss)])
        mean = [None if not k else float((sums[b] - sums[a]) / k) for k, a, b in zip(x.counts.tolist(), x.starts[:-1], x.starts[1:])]
        return C.result(x.table, n_tokens=pa.array(x.counts, pa.int64()), score=pa.array(mean, pa.float64()))

    counted = left.groupBy("batch").applyInArrow(ask_words, C.MSG).groupBy("dest").applyInArrow(count_words, C.MSG)
    told = counted.filter("dest >= 0")
    totals = counted.filter("dest < 0").groupBy("dest").applyInArrow(add_up, C.MSG) \
        .select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("dest"), "src", "kind", "data")
    pairs = left.groupBy("batch").cogroup(told.groupBy("dest")).applyInArrow(ask_pairs, C.MSG)
    answers = told.unionAll(totals).unionAll(pairs.groupBy("dest").applyInArrow(count_pairs, C.MSG))
    out = left.groupBy("batch").cogroup(answers.groupBy("dest")).applyInArrow(per_token, C.out_schema(left, "n_tokens bigint, score double"))
    return C.with_carried(out, carry, id_col)


#: The ``op2`` query in DuckDB SQL (scores to six decimals).
LM_SQL = r"""
WITH target AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, doc_id IN (SELECT doc_id FROM target) AS aimed FROM documents),
raw AS (SELECT doc_id, aimed, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
vocabulary AS (SELECT word FROM raw WHERE aimed GROUP BY word HAVING count(*) >= 10),
toks AS (SELECT raw.doc_id, aimed, i, coalesce(v.word, '') AS w FROM raw LEFT JOIN vocabulary v ON v.word = raw.word),
seq AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY doc_id ORDER BY i), ' ') AS h FROM toks),
sums AS (SELECT count(*) AS n, count(*) FILTER (aimed) AS nt, (SELECT count(*) FROM vocabulary) AS v FROM toks),
uni AS (SELECT w, count(*) AS c, count(*) FILTER (aimed) AS ct FROM toks GROUP BY w),
bi AS (SELECT h, w, count(*) AS c, count(*) FILTER (aimed) AS ct FROM seq GROUP BY h, w),
heads AS (SELECT h, sum(c) AS c, sum(ct) AS ct FROM bi GROUP BY h),
ones AS (SELECT w, (c + 1.0::double) / (n + v + 1) AS p, (ct + 1.0::double) / (nt + v + 1) AS pt FROM uni CROSS JOIN sums),
loss AS (SELECT bi.h, bi.w, ln(0.7::double * bi.c / heads.c + 0.3::double * ones.p)
                - ln(CASE WHEN heads.ct > 0 THEN 0.7::double * bi.ct / heads.ct + 0.3::double * ones.pt ELSE ones.pt END) AS x
         FROM bi JOIN heads ON heads.h = bi.h JOIN ones ON ones.w = bi.w),
scores AS (SELECT seq.doc_id, avg(loss.x) AS score FROM seq JOIN loss ON loss.h = seq.h AND loss.w = seq.w GROUP BY seq.doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_tokens, round(scores.score, 6) AS score FROM d LEFT JOIN scores ON scores.doc_id = d.doc_id
"""
