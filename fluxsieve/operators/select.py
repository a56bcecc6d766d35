"""Rows at given ranks of a sort order, without sorting or moving rows.

The sort columns alone are written once as a narrow table, which all passes read.  A rank is bracketed
by quantile sketches (``percentile_approx``: mergeable, so one aggregate serves all ranks of all columns
at once).  Counts then say how many rows lie below and inside each bracket, exactly; brackets that still
hold many rows are sketched again, and a bracket of one hot value goes on with the next sort column.
What is left, at most ``SMALL`` keys a rank, is sorted.  A wide table is cut by comparing its rows with the
key found (:func:`before`): it is read once, and neither exchanged nor written.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Relative rank accuracy of a sketch is 1 / ACCURACY; keys of one bracket that are sorted.
ACCURACY, SMALL = 2_000, 20_000


def before(order, key) -> Column:
    """Rows that sort before ``key`` by the columns ``order`` (ascending, missing values last)."""
    out = F.lit(False)
    for c, v in reversed(list(zip(order, key))):
        c = F.col(c) if isinstance(c, str) else c
        if v is None:
            out = c.isNotNull() | out
        else:
            out = F.coalesce(c < F.lit(v), F.lit(False)) | (c.eqNullSafe(F.lit(v)) & out)
    return out


@dataclass
class _Search:
    """One rank being looked for: it counts from the first row that has the values fixed so far and, once there is a
    bracket, lies in it; ``rows`` are such rows."""

    order: list[Column]
    rank: int
    rows: int
    key: list = field(default_factory=list)
    bracketed: bool = False
    low: object = None
    high: object = None

    @property
    def done(self) -> bool:
        return len(self.key) == len(self.order)

    @property
    def column(self) -> Column:
        return self.order[len(self.key)]

    def fixed(self) -> Column:
        out = F.lit(True)
        for c, v in zip(self.order, self.key):
            out = out & c.eqNullSafe(F.lit(v))
        return out

    def inside(self) -> Column:
        """Rows of the bracket, whose ends do not belong to it."""
        out = self.fixed() & self.column.isNotNull()
        if self.low is not None:
            out = out & (self.column > F.lit(self.low))
        return out if self.high is None else out & (self.column < F.lit(self.high))

    def left(self) -> Column:
        return self.inside() if self.bracketed else self.fixed()

    def fix(self, value) -> None:
        self.key.append(value)
        self.bracketed, self.low, self.high = False, None, None


def keys_at(df: DataFrame, requests) -> list[tuple | None]:
    """For each ``(order, rank)`` the values of the ``order`` columns in the row at that 0-based rank, ascending with
    missing values last; None where there is no such row.  Columns are numeric; where rows may tie, the last one is the
    unique id.  A rank may be a function of the number of rows."""
    requests = list(requests)
    if not requests:
        return []
    named: dict = {}                                       # sort column (a name or an expression) -> its name in the key table
    for order, _ in requests:
        for c in order:
            named.setdefault(c if isinstance(c, str) else id(c), (f"k{len(named)}", F.col(c) if isinstance(c, str) else c))
    df = cut_lineage(df.select(*[c.alias(k) for k, c in named.values()]))
    n = df.count()
    every = [_Search([F.col(named[c if isinstance(c, str) else id(c)][0]) for c in order], rank(n) if callable(rank) else rank, n) for order, rank in requests]
    todo = [s for s in every if 0 <= s.rank < n]
    while todo:
        wide = [s for s in todo if s.rows > SMALL]
        _skip_missing(df, [s for s in wide if not s.bracketed])
        _narrow(df, [s for s in wide if s.bracketed])
        _finish(df, [s for s in todo if not s.done and s.rows <= SMALL])
        todo = [s for s in todo if not s.done]
    return [tuple(s.key) if s.done else None for s in every]


def _skip_missing(df: DataFrame, searches: list[_Search]) -> None:
    """Open a bracket around all values of the column at hand, or go on to the rows that have none."""
    if not searches:
        return
    got = df.agg(*[F.count(F.when(s.inside(), 1)).alias(f"c{i}") for i, s in enumerate(searches)]).first()
    for i, s in enumerate(searches):
        if s.rank < got[i]:
            s.bracketed, s.rows = True, got[i]
        else:
            s.rank, s.rows = s.rank - got[i], s.rows - got[i]
            s.fix(None)


def _narrow(df: DataFrame, searches: list[_Search]) -> None:
    """A narrower bracket for each search: one sketch pass and one counting pass for all of them."""
    if not searches:
        return
    slack = 2.0 / ACCURACY
    got = df.agg(*[F.percentile_approx(F.when(s.inside(), s.column), F.array(
        F.lit(max(0.0, s.rank / s.rows - slack)), F.lit(min(1.0, (s.rank + 1) / s.rows + slack))), F.lit(ACCURACY)).alias(f"q{i}")
        for i, s in enumerate(searches)]).first()
    ends = [tuple(got[i]) for i in range(len(searches))]
    def counts(i, s, lo, hi):
        c, count = s.column, lambda cond: F.count(F.when(s.inside() & cond, 1))
        return [count(c < F.lit(lo)).alias(f"below{i}"), count(c == F.lit(lo)).alias(f"low{i}"),
                count((c > F.lit(lo)) & (c < F.lit(hi))).alias(f"within{i}"), count((c == F.lit(hi)) & (c > F.lit(lo))).alias(f"high{i}")]

    got = df.agg(*[c for i, (s, (lo, hi)) in enumerate(zip(searches, ends)) for c in counts(i, s, lo, hi)]).first()
    for i, (s, (lo, hi)) in enumerate(zip(searches, ends)):
        below, at_low, within, at_high = (got[f"{k}{i}"] for k in ("below", "low", "within", "high"))
        rank = s.rank - below
        if not 0 <= rank < at_low + within + at_high:
            raise RuntimeError(f"a quantile sketch was off by more than {slack} of {s.rows} rows")
        if rank < at_low:
            s.rank, s.rows = rank, at_low
            s.fix(lo)
        elif rank < at_low + within:
            s.rank, s.rows, s.low, s.high = rank - at_low, within, lo, hi
        else:
            s.rank, s.rows = rank - at_low - within, at_high
            s.fix(hi)


def _finish(df: DataFrame, searches: list[_Search]) -> None:
    """Sort the few keys that are left of each search, in one aggregate for all."""
    if not searches:
        return

    def key(s):
        rest = s.order[len(s.key):]
        return F.struct(*[x for k, c in enumerate(rest) for x in (c.isNull().alias(f"m{k}"), c.alias(f"v{k}"))])

    got = df.agg(*[F.element_at(F.sort_array(F.collect_list(F.when(s.left(), key(s)))), s.rank + 1).alias(f"k{i}") for i, s in enumerate(searches)]).first()
    for i, s in enumerate(searches):
        s.key += [got[i][f"v{k}"] for k in range(len(s.order) - len(s.key))]


def quantiles(df: DataFrame, wants: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of the present values of each column, all columns side by side."""
    n = df.agg(*[F.count(c).alias(c) for c in wants]).first()
    at = {c: [p * (n[c] - 1) for p in probs] for c, probs in wants.items()}
    ranks = [(c, r) for c, places in at.items() if n[c] for r in sorted({r for a in places for r in (math.floor(a), math.ceil(a))})]
    value = {w: float(k[0]) for w, k in zip(ranks, keys_at(df, [([c], r) for c, r in ranks]))}

    def between(c, a):
        low, high = value[c, math.floor(a)], value[c, math.ceil(a)]
        return low + (high - low) * (a - math.floor(a)) if high != low else low

    return {c: [between(c, a) if n[c] else None for a in places] for c, places in at.items()}


def hash_order(seed, key: str) -> list[Column]:
    """``md5('<seed>|<id>')`` and the id as numeric sort columns: the digest's hexadecimal digits in three parts."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return [F.conv(F.substring(digest, i, n), 16, 10).cast("long") for i, n in ((1, 13), (14, 13), (27, 6))] + [F.col(key)]
