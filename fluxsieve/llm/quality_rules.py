"""Quality rules with adaptive thresholds (operator 5, native).

Fixed cutoffs fail across languages and sources, so the thresholds come from the data: for each
language and source a mergeable quantile sketch of each measure is kept, its quartiles give an
upper and a lower fence, and documents outside a fence of their own language and source are
rejected.  Sketches have a row per logarithmic bin (relative error 1 %, at most some 1,100 bins
whatever the input), so merging is adding counts: groups with fewer than ``least_rows`` sketched
documents use the merged sketch of their language, or of everything.

Sketches hold the documents that pass the base rules, and a fence is set from the median and the
quartile on its *other* side, so that junk moves it little while it makes up less than half of a
group: at 40 % junk above, the median is still the 83rd and the lower quartile the 42nd percentile
of what is clean.

Measures of a document and the fences they face:

* symbols per word and repeated lines per ten words: above ``q50 + 7 * (q50 - q25) + slack``;
* mean word length: above ``q50 + 13 * (q50 - q25) + slack`` or below ``q50 - 13 * (q75 - q50) - slack``.

For a symmetric measure these are 3 and 6 quartile distances beyond the quartiles.

The slack is the least difference that counts at all, so that a group where nearly all documents
agree does not reject the first that differs.

Two base rules come first: fewer than 10 words, or over 20 % of the words in 5-word windows that
occur twice in the text.

Defined results: null texts have no words (and fail the base rules); null languages and sources
are groups of their own; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .mixing import WHITE

#: Words of a repeated window; base rule limits.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = "#*$%&|<>"
#: Ratio of neighbouring bin limits, and the value below which a measure is in the zero bin.
GAMMA, TINY = 1.02, 1e-6
#: measure: (multiples of the distance from median to quartile, slack, has a lower fence).
FENCES = {"symbols_per_word": (7.0, 0.25, False), "repeated_lines": (7.0, 0.3, False), "mean_word_chars": (13.0, 1.0, True)}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def measures(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``.

    Repeated windows are found by 64-bit hashes within one text.  Each step is a projection of its
    own, since an expression inlined into a lambda would be evaluated for every element.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(*keep, text.alias("_t"))
    named = [F.col(c) for c in base.columns[:-1]]
    lines = F.filter(F.split("_t", "\n"), lambda x: F.translate(x, WHITE + " ", "") != "")
    one = base.select(*named, words(F.col("_t")).alias("_w"), lines.alias("_lines"),
                      F.length(F.translate("_t", WHITE + " ", "")).cast("long").alias("word_chars"),
                      (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"))
    named += [F.col("word_chars"), F.col("n_symbols")]
    two = one.select(*named, F.size("_w").cast("long").alias("n_words"),
                     (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                     F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
    named += [F.col("n_words"), F.col("n_dup_lines")]
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    three = two.select(*named, F.transform(at, lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)])).alias("_win"))
    again = F.size(F.array_distinct("_win")) < F.size("_win")
    four = three.select(*named, F.when(again, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    twin = F.filter("_s", lambda e, i: (F.get("_s", i - 1)["h"] == e["h"]) | (F.get("_s", i + 1)["h"] == e["h"]))
    five = four.select(*named, F.sort_array(F.transform(twin, lambda e: e["i"])).alias("_p"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct(
        (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).cast("long").alias("n"), p.alias("last")), lambda a: a["n"])
    return five.select(*named, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def _bin(x: Column) -> Column:
    """Sketch bin of a measure: 0 below ``TINY``, then logarithmic bins from 1."""
    return F.when(x < TINY, 0).otherwise(F.ceil(F.log(x / TINY) / math.log(GAMMA)).cast("int") + 1)


def _value(b: Column) -> Column:
    """Middle of a bin."""
    return F.when(b == 0, 0.0).otherwise(TINY * F.pow(F.lit(GAMMA), b - 1.5))


def thresholds(found: DataFrame, least_rows: int) -> DataFrame:
    """Fences ``<measure>_low`` and ``<measure>_high`` for each ``no_lang, lang, no_source, source``.

    ``found`` has those four columns and the measures of the documents to sketch; a group without any has no fences.
    """
    group = ["no_lang", "lang", "no_source", "source"]
    bins = F.array(*[F.struct(F.lit(m).alias("measure"), _bin(F.col(m)).alias("bin")) for m in FENCES])
    sketch = found.select(*group, F.explode(bins).alias("b")).groupBy(*group, "b.measure", "b.bin").agg(F.count("*").alias("n"))
    rows = sketch.filter(F.col("measure") == next(iter(FENCES))).groupBy(*group).agg(F.sum("n").alias("rows")) \
        .withColumn("lang_rows", F.sum("rows").over(Window.partitionBy("no_lang", "lang")))
    own, of_lang, of_all = (F.concat_ws("\0", F.lit(k), *map(F.col, c)) for k, c in
                            (("own", group), ("lang", group[:2]), ("all", [])))
    where = F.when(F.col("rows") >= least_rows, own).when(F.col("lang_rows") >= least_rows, of_lang).otherwise(of_all)
    users = rows.select(*group, where.alias("sketch"))
    merged = sketch.select(F.explode(F.array(own, of_lang, of_all)).alias("sketch"), "measure", "bin", "n") \
        .groupBy("sketch", "measure", "bin").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("sketch", "measure").orderBy("bin")
    ranked = merged.withColumn("upto", F.sum("n").over(up)) \
        .withColumn("total", F.sum("n").over(Window.partitionBy("sketch", "measure")))
    quantile = lambda q: _value(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("bin"))))
    quartiles = ranked.groupBy("sketch", "measure").agg(
        quantile(0.25).alias("q25"), quantile(0.5).alias("q50"), quantile(0.75).alias("q75"))
    fences = []
    for m, (times, slack, low) in FENCES.items():
        mine, middle = F.col("measure") == m, F.col("q50")
        fences.append(F.max(F.when(mine, middle + times * (middle - F.col("q25")) + slack)).alias(f"{m}_high"))
        if low:
            fences.append(F.max(F.when(mine, middle - times * (F.col("q75") - middle) - slack)).alias(f"{m}_low"))
    return users.join(quartiles.groupBy("sketch").agg(*fences), "sketch").drop("sketch")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_rows: int = 200) -> DataFrame:
    """Id, counts, ``base_failed``, ``kept`` and the ``reason`` (null if kept) of every document."""
    keep = [F.col(id_col).alias("id"), F.col(lang_col).isNull().alias("no_lang"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
            F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")]
    words_or_1 = F.greatest(F.col("n_words"), F.lit(1))
    found = cut_lineage(measures(docs, text_col, keep)) \
        .withColumn("symbols_per_word", F.col("n_symbols") / words_or_1) \
        .withColumn("repeated_lines", F.col("n_dup_lines") / words_or_1 * 10.0) \
        .withColumn("mean_word_chars", F.col("word_chars") / words_or_1) \
        .withColumn("base_failed", (F.col("n_words") < LEAST_WORDS)
                    | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    group = ["no_lang", "lang", "no_source", "source"]
    joined = found.join(thresholds(found.filter(~F.col("base_failed")), least_rows), group, "left")
    reason = F.when(F.col("base_failed"), "base")
    for m, (_, _, low) in FENCES.items():
        reason = reason.when(F.col(m) > F.col(f"{m}_high"), m)
        if low:
            reason = reason.when(F.col(m) < F.col(f"{m}_low"), m)
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", reason.isNull().alias("kept"), reason.alias("reason"))


def _sql() -> str:
    """The same rules in DuckDB SQL."""
    bins = "CASE WHEN x < {t} THEN 0 ELSE ceil(ln(x / {t}) / ln({g}))::int + 1 END".format(t=TINY, g=GAMMA)
    value = f"CASE WHEN {{0}} = 0 THEN 0.0 ELSE {TINY} * pow({GAMMA}, {{0}} - 1.5) END"
    high, low = [], []
    for m, (times, slack, has_low) in FENCES.items():
        high.append(f"max(CASE WHEN measure = '{m}' THEN q50 + {times} * (q50 - q25) + {slack} END) AS {m}_high")
        if has_low:
            low.append(f"max(CASE WHEN measure = '{m}' THEN q50 - {times} * (q75 - q50) - {slack} END) AS {m}_low")
    reason = "".join(f" WHEN d.{m} > t.{m}_high THEN '{m}'" + (f" WHEN d.{m} < t.{m}_low THEN '{m}'" if f[2] else "")
                     for m, f in FENCES.items())
    return rf"""
WITH base AS (SELECT doc_id, coalesce(lang, '~') AS lang, coalesce(source, '~') AS source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base),
tokens AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM split),
wins AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2, lead(w, 3) OVER o AS w3, lead(w, 4) OVER o AS w4
         FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2, w3, w4) AS n FROM wins WHERE w4 IS NOT NULL),
marked AS (SELECT t.doc_id, t.i, max(CASE WHEN s.n > 1 THEN s.i END) OVER (PARTITION BY t.doc_id ORDER BY t.i) AS last
           FROM tokens t LEFT JOIN twins s ON s.doc_id = t.doc_id AND s.i = t.i),
rep AS (SELECT doc_id, count(*) AS n FROM marked WHERE last > i - {WINDOW} GROUP BY doc_id),
counts AS (SELECT s.doc_id, lang, source, len(w)::bigint AS n_words,
                  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint AS word_chars,
                  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
                  (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words
           FROM split s LEFT JOIN rep ON rep.doc_id = s.doc_id),
d AS (SELECT *, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_words, 1) * 10.0 AS repeated_lines,
             word_chars / greatest(n_words, 1) AS mean_word_chars,
             n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM counts),
sound AS (SELECT * FROM d WHERE NOT base_failed),
long AS (SELECT lang, source, measure, x FROM sound UNPIVOT (x FOR measure IN ({', '.join(FENCES)}))),
sketch AS (SELECT lang, source, measure, {bins} AS bin, count(*) AS n FROM long GROUP BY ALL),
groups AS (SELECT *, sum(rows) OVER (PARTITION BY lang) AS lang_rows FROM (SELECT lang, source, count(*) AS rows FROM sound GROUP BY ALL)),
users AS (SELECT lang, source, CASE WHEN rows >= 200 THEN 'own' || lang || chr(1) || source
                                    WHEN lang_rows >= 200 THEN 'lang' || lang ELSE 'all' END AS sketch FROM groups),
every AS (SELECT unnest(['own' || lang || chr(1) || source, 'lang' || lang, 'all']) AS sketch, measure, bin, n FROM sketch),
merged AS (SELECT sketch, measure, bin, sum(n) AS n FROM every GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY sketch, measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY sketch, measure) AS total FROM merged),
q AS (SELECT sketch, measure, min(CASE WHEN upto >= 0.25 * total THEN bin END) AS b25,
             min(CASE WHEN upto >= 0.5 * total THEN bin END) AS b50, min(CASE WHEN upto >= 0.75 * total THEN bin END) AS b75
      FROM ranked GROUP BY ALL),
quartiles AS (SELECT sketch, measure, {value.format('b25')} AS q25, {value.format('b50')} AS q50, {value.format('b75')} AS q75 FROM q),
fences AS (SELECT sketch, {', '.join(high + low)} FROM quartiles GROUP BY sketch),
t AS (SELECT users.lang, users.source, fences.* FROM users JOIN fences USING (sketch)),
judged AS (SELECT d.*, CASE WHEN base_failed THEN 'base'{reason} END AS reason FROM d LEFT JOIN t ON d.lang = t.lang AND d.source = t.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, reason IS NULL AS kept, reason FROM judged
"""


RULES_SQL = _sql()
