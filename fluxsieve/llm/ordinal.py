"""Quality classifier: ordinal cumulative-link regression on graded ratings (operator 3).

``P(grade <= k) = sigmoid(threshold_k - margin)`` with one margin for all grades: the sum of the
weights of a text's hashed features.  Thresholds are kept in order by construction.  The model
gives each document its expected grade and the probability of at least the wanted grade, by
which documents are selected.

Features (presence, hashed to ``2^bits`` weights): the lower-cased words without ASCII
punctuation, their first four bytes (word stems), and a few bucketed shape words (symbols and
exclamation marks per word, capitals, share of different words, share of repeated lines, mean word length).

The fit uses at most ``fit_rows`` rated documents, chosen by hash of the id; that bound is a
parameter and the only sample.  Scoring reads every document whole, in one pass without a
shuffle; the weights (4 * 2^bits bytes) are all that is broadcast.

Defined results: ratings with a null id or grade are ignored; without usable ratings there is no
model: expected grade and probability are null and every document is selected.  A null or empty
text has only shape features.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import common as C

#: ASCII punctuation becomes space before words are taken.
_PUNCT = bytes(32 if not (chr(b).isalnum() or b > 127) else b for b in range(256))
_SYMBOLS, _CAPITALS = b"#*$%&|<>!", bytes(range(65, 91))
STEM = 4
#: Features per shape word, so that hundreds of words do not outweigh it.
SHAPE = 16


@dataclasses.dataclass
class OrdinalModel:
    weights: np.ndarray          # float32, 2^bits
    thresholds: np.ndarray       # ordered, one fewer than grades

    @property
    def bits(self) -> int:
        return len(self.weights).bit_length() - 1

    def at_least(self, margin: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each k, a column per threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - margin[:, None], -60, 60)))

    def expected(self, margin: np.ndarray) -> np.ndarray:
        return self.at_least(margin).sum(axis=1)


def shape_words(raw: bytes, n_words: int, n_distinct: int) -> list[bytes]:
    """Bucketed features of a text's form."""
    n = max(n_words, 1)
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    level = lambda name, x: b"\0%s%d" % (name, int(x))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    own = [level(b"sym", min(8, 8 * symbols / n)), level(b"cap", 10 * capitals / max(len(raw), 1)), level(b"dis", 10 * n_distinct / n),
            level(b"dup", 10 * (1 - len(set(lines)) / max(len(lines), 1))), level(b"len", min(24, 2 * len(raw) / n)),
            b"\0bias"]
    return [x + b"#%d" % k for x in own for k in range(SHAPE)]


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_PUNCT).split()


def names_of(raw: bytes) -> list[bytes]:
    """The features of a text by name, each once."""
    w = words_of(raw)
    seen = set(w)
    stems = {b"^" + x[:STEM] for x in seen if len(x) > STEM}
    return [*sorted(seen), *sorted(stems), *shape_words(raw, len(w), len(seen))]


def features(raw: bytes, bits: int) -> np.ndarray:
    """Distinct feature numbers of a text, in order."""
    top = (1 << bits) - 1
    names = names_of(raw)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 11) & top for x in names), np.int32, len(names)))


def _descend(value_and_slope, x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """Limited-memory BFGS with step halving, for a smooth convex function."""
    f, g = value_and_slope(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, y, r in reversed(past):
            alphas.append(r * (s @ d))
            d = d - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, float(np.abs(g).sum()))
        for (s, y, r), al in zip(past, reversed(alphas)):
            d = d + (al - r * (y @ d)) * s
        slope, t = float(g @ d), 1.0
        while t > 1e-8:
            new_f, new_g = value_and_slope(x + t * d)
            if new_f <= f + 1e-4 * t * slope:
                break
            t /= 2
        else:
            break
        s, y = t * d, new_g - g
        if s @ y > 1e-12:
            past = [*past, (s, y, 1.0 / (s @ y))][-memory:]
        done = abs(f - new_f) <= 1e-7 * max(1.0, abs(f))
        x, f, g = x + s, new_f, new_g
        if done:
            break
    return x


def fit_arrays(rows: np.ndarray, starts: np.ndarray, grades: np.ndarray, n_grades: int, bits: int,
               steps: int = 200, l2: float = 3e-4, least_df: int = 10) -> OrdinalModel:
    """Least mean negative log-likelihood with a quadratic penalty (``rows``: feature numbers, document after document).

    Features of fewer than ``least_df`` rated documents keep weight zero.
    """
    size, n = 1 << bits, len(grades)
    doc = np.repeat(np.arange(n), np.diff(np.append(starts, len(rows))))
    often = np.bincount(rows, minlength=size) >= least_df
    doc, rows = doc[often[rows]], rows[often[rows]]
    used, col = np.unique(rows, return_inverse=True)
    k = len(used)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    up, down = grades < n_grades - 1, grades > 0

    def thresholds(x):
        return x[k] + np.concatenate([[0], np.cumsum(np.exp(x[k + 1:]))])   # the gaps are exponentials: always in order

    def loss(x):
        w, theta = x[:k], thresholds(x)
        m = np.bincount(doc, w[col], n)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        hi, lo = sig(edges[grades + 1] - m), sig(edges[grades] - m)
        hi[~up], lo[~down] = 1.0, 0.0
        p = np.maximum(hi - lo, 1e-12)
        g_theta = np.zeros(n_grades - 1)
        np.add.at(g_theta, grades[up], (-hi * (1 - hi) / p)[up] / n)
        np.add.at(g_theta, grades[down] - 1, (lo * (1 - lo) / p)[down] / n)
        g_w = np.bincount(col, ((1 - hi - lo) / n)[doc], k) + l2 * w
        g_t = np.concatenate([[g_theta.sum()], np.cumsum(g_theta[::-1])[::-1][1:] * np.exp(x[k + 1:])])
        return -np.log(p).mean() + l2 / 2 * float(w @ w), np.concatenate([g_w, g_t])

    x = _descend(loss, np.concatenate([np.zeros(k), start[:1], np.log(np.maximum(np.diff(start), 1e-2))]), steps)
    weights = np.zeros(size, np.float32)
    weights[used] = x[:k]
    return OrdinalModel(weights, thresholds(x))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text",
        grade_col: str = "grade", fit_rows: int = 12_000, bits: int = 18) -> OrdinalModel | None:
    """Fit on at most ``fit_rows`` ratings (grades ``0 .. n_grades - 1``) of documents in ``docs``.

    A rating given twice counts once; of several texts of a rated id the least counts.  ``None`` without ratings
    or without documents; ratings of which none belongs to a document are an error.
    """
    ship_package(docs.sparkSession)
    grade = F.col(grade_col).cast("int")
    graded = ratings.select(F.col(id_col).cast("long").alias("id"), grade.alias("grade")) \
        .filter(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    rated = graded.join(texts.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id", "grade").limit(fit_rows)
    sample = texts.join(F.broadcast(rated), "id").groupBy("id", "grade").agg(F.min("text").alias("text"))   # bounded by fit_rows

    def extract(batches):
        for b in batches:
            f = [features(t or b"", bits).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(f), pa.int32()), b.column("id"), b.column("grade"),
                                              pa.array(f, pa.binary())], names=["one", "id", "grade", "feats"])

    def train(key, table):
        rows = sorted(zip(table.column("id").to_pylist(), table.column("grade").to_pylist(), table.column("feats").to_pylist()))
        parts = [np.frombuffer(f, np.int32) for _, _, f in rows]
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]]).astype(np.int64)
        model = fit_arrays(np.concatenate(parts), starts, np.array([g for _, g, _ in rows], np.int64), n_grades, bits)
        return pa.table([pa.array([C.pack(model.weights, model.thresholds)], pa.binary())], names=["model"])

    got = sample.select("id", "grade", "text").mapInArrow(extract, "one int, id bigint, grade int, feats binary") \
        .groupBy("one").applyInArrow(train, "model binary").collect()      # one row of 4 * 2^bits bytes
    if not got:
        if graded.isEmpty() or texts.isEmpty():
            return None
        raise ValueError("none of the rated documents is among the documents to fit on")
    return OrdinalModel(*C.unpack(bytes(got[0][0]), np.float32, np.float64))


class _Weights(dict):
    """word -> weight, remembering a bounded number of words."""

    def __init__(self, model: OrdinalModel):
        super().__init__()
        self.weights, self.top = model.weights.astype(np.float64).tolist(), (1 << model.bits) - 1

    def __missing__(self, word: bytes) -> float:
        x = self.weights[xxhash.xxh64_intdigest(word, 11) & self.top]
        if len(self) >= 1 << 19:
            self.clear()
        self[word] = x
        return x


def margin(raw: bytes, cache: _Weights) -> float:
    """The sum of the weights of the text's features."""
    return sum(map(cache.__getitem__, names_of(raw)))


def score(docs: DataFrame, model: OrdinalModel | None, tail_grade: int, least_tail: float = 0.5, id_col: str = "doc_id",
          text_col: str = "text", carry=()) -> DataFrame:
    """Carried columns (default the id) with ``expected_grade``, ``tail_probability`` (of at least
    ``tail_grade``) and ``selected`` (that probability reaches ``least_tail``)."""
    ship_package(docs.sparkSession)
    cols = list(carry or [id_col])
    src = docs.select(F.struct(*[F.col(c) for c in cols]).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    if model is None:
        return src.select(*[F.col("doc").getField(c).alias(c) for c in cols], F.lit(None).cast("double").alias("expected_grade"),
                          F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("selected"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        cache = _Weights(m)
        for b in batches:
            z = np.array([margin(t or b"", cache) for t in b.column("text").to_pylist()], np.float64)
            above = m.at_least(z)
            tail = above[:, tail_grade - 1]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc"), pa.array(above.sum(axis=1), pa.float64()), pa.array(tail, pa.float64()),
                 pa.array(tail >= least_tail, pa.bool_())], names=["doc", "expected_grade", "tail_probability", "selected"])

    out = src.mapInArrow(run, C.out_schema(src, "expected_grade double, tail_probability double, selected boolean"))
    return out.select(*[F.col("doc").getField(c).alias(c) for c in cols], "expected_grade", "tail_probability", "selected")
