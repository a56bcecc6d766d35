"""Row filters (2.C): predicates that drop a whole point.

Every filter is a ``Column`` builder over a schema (the column policy is resolved
on the driver from ``df.columns``) plus a thin ``DataFrame -> DataFrame`` wrapper.
pandas semantics are kept: a comparison with a missing value is False, so every
predicate is wrapped in ``coalesce(..., false)`` before it is negated or combined.

The sanity chain folds all steps into one lazy plan (Catalyst merges the
filters into a single codegen stage next to the scan); its yield report is one
aggregate with cumulative predicates, not one count per step.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.numeric import INF, all_of, any_of, fuzzy_is_in, isclose, is_finite, true_or_false  # noqa: F401

Pred = Callable[[DataFrame], Column]


# ---------------------------------------------------------------- predicates

# Every predicate is ``pred(df, r=F.col)``: ``r`` resolves a column name to an expression, so a
# predicate can be evaluated on substituted values.  Its value is
# True or False, never missing, so it can be negated.  A range predicate also carries ``plain``,
# the same test as bare comparisons that a scan can take over (a missing value drops the row
# either way), and the columns it reads.

def _ranges(*bounds: tuple[str, str, float]) -> Pred:
    """Conjunction of ``column op value`` comparisons (op one of ``< > <= >=``)."""
    ops = {"<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v}

    def test(df, r=F.col):
        return true_or_false(all_of(ops[op](r(c), v) for c, op, v in bounds))
    test.plain = lambda: [ops[op](F.col(c), F.lit(float(v))) for c, op, v in bounds]
    test.reads = {c for c, _, _ in bounds}
    return test


def _abs_lt(column: str, bound: float) -> Pred:
    return _ranges((column, ">", -bound), (column, "<", bound))


def cke_ok(bound: float) -> Pred:
    return _abs_lt("cke", bound)


def cki_ok(bound: float) -> Pred:
    return _abs_lt("cki", bound)


def ceke_ok(bound: float) -> Pred:
    return _abs_lt("ceke", bound)


def ceki_ok(bound: float) -> Pred:
    return _abs_lt("ceki", bound)


def ck_ok(bound: float) -> Pred:
    """C-06: cke and cki both converged."""
    return _ranges(*[(c, op, v) for c in ("cke", "cki") for op, v in ((">", -bound), ("<", bound))])


def cek_ok(bound: float) -> Pred:
    return _ranges(*[(c, op, v) for c in ("ceke", "ceki") for op, v in ((">", -bound), ("<", bound))])


def negative_columns(columns, policy: str = "current") -> list[str]:
    """C-03 / C-04 column policies for the non-negative heat-flux test."""
    if policy == "current":
        return N.columns_where(columns, lambda c: N.is_pure_heat(c) and N.is_pure_flux(c))
    if policy == "gen4":  # every all-heat column, ratios and diffusivities included
        return N.columns_where(columns, N.is_pure_heat)
    if policy == "gen2":  # every single-part column whose transp is a heat variable
        return N.columns_where(columns, lambda c: N.is_pure(c) and N.split_name(c)[0] in N.HEAT)
    raise ValueError(f"unknown policy {policy!r}")


def nonnegative_ok(policy: str = "current") -> Pred:
    """C-03: all heat fluxes >= 0 (a missing value fails)."""
    return lambda df, r=F.col: all_of(true_or_false(r(c) >= 0) for c in negative_columns(df.columns, policy))


def _families(transps) -> dict[str, list[str]]:
    """Total -> separate modes for each transport variable: ions ITG / TEM, electrons ETG / ITG / TEM."""
    out = {}
    for t in transps:
        out[f"{t}i_GB"] = ["ITG", "TEM"]
        out[f"{t}e_GB"] = ["ETG", "ITG", "TEM"]
    return out


SEPTOT_FAMILIES = {
    # fixed values: total flux -> separate modes compared with it
    "current": {"efi_GB": ["ITG", "TEM"], "efe_GB": ["ETG", "ITG", "TEM"]},
    "gen4": _families(N.HEAT),                                          # C-08: every heat variable
    # heat: the energy flux alone; particle variables (no pinch of rotation): ions and electrons ITG / TEM only
    "gen2": _families(["ef"]) | {f"{t}{s}_GB": ["ITG", "TEM"] for t in N.PARTICLE if t not in ("vr", "ver") for s in "ie"},
}


def septot_pairs(columns, families: str | dict = "current") -> list[tuple[str, list[str]]]:
    fam = SEPTOT_FAMILIES[families] if isinstance(families, str) else families
    out = []
    strict = isinstance(families, dict) or families == "current"
    for tot, modes in fam.items():
        head, norm = tot.rsplit("_", 1)
        seps = [f"{head}{m}_{norm}" for m in modes if f"{head}{m}_{norm}" in columns]
        if tot not in columns:
            if strict:
                raise KeyError(tot)
            continue  # generated families: only totals present in the schema take part
        out.append((tot, seps))
    return out


def septot_ok(factor: float, families="current") -> Pred:
    """C-07: every existing separate-mode flux |sep| <= factor * |total|."""
    def pred(df, r=F.col):
        return all_of(true_or_false(F.abs(r(s)) <= F.lit(factor) * F.abs(r(t)))
                      for t, seps in septot_pairs(df.columns, families) for s in seps)
    return pred


def ambipolar_ok(bound: float, version: int = 1) -> Pred:
    """C-09: v0 ``1/b < absambi < b``; v1 ``|absambi - 1| < b`` (strict)."""
    if version == 0:
        return _ranges(("absambi", "<", bound), ("absambi", ">", 1.0 / bound))
    if version == 1:
        return _ranges(("absambi", "<", 1.0 + bound), ("absambi", ">", 1.0 - bound))
    raise ValueError(f"ambipolarity rule {version!r} is not one of 0, 1")


def femto_columns(columns, policy: str = "current") -> list[str]:
    if policy == "current":
        return N.columns_where(columns, lambda c: N.is_transport(c) and N.is_pure_flux(c))
    if policy in ("gen4", "gen2"):  # every single-part transport column
        return N.columns_where(columns, lambda c: N.is_transport(c) and N.is_pure(c))
    raise ValueError(policy)


def femtoflux_ok(bound: float, policy: str = "current") -> Pred:
    """C-10: no transport flux with ``0 < |v| < bound`` (missing counts as fine)."""
    def pred(df, r=F.col):
        sizes = [F.when(r(c) != 0, F.abs(r(c))) for c in femto_columns(df.columns, policy)]
        least = F.least(*sizes) if len(sizes) > 1 else sizes[0] if sizes else F.lit(None).cast("double")
        return F.coalesce(least >= bound, F.lit(True))
    return pred


def regime_ok(geq: float, less: float) -> Pred:
    """C-02: ``geq <= efe_GB, efi_GB < less``."""
    return _ranges(*[(c, op, v) for c in ("efe_GB", "efi_GB") for op, v in (("<", less), (">=", geq))])


# ---------------------------------------------------------------- wrappers

def apply(df: DataFrame, pred: Pred) -> DataFrame:
    return df.filter(all_of(pred.plain()) if hasattr(pred, "plain") else pred(df))


def regime_filter(df: DataFrame, geq: float, less: float) -> DataFrame:
    return apply(df, regime_ok(geq, less))


def input_range_filter(inp: DataFrame, data: DataFrame, filter_ranges: dict | None = None,
                       key: str = "dimx") -> DataFrame:
    """C-01: keep data rows whose input has ``x`` and every feature within [low, high]."""
    cond = [F.col("x").isNotNull()]
    for k, (lo, hi) in (filter_ranges or {}).items():
        cond.append(true_or_false((F.col(k) >= lo) & (F.col(k) <= hi)))
    ok_ids = inp.filter(all_of(cond)).select(key)
    return data.join(ok_ids, key, "left_semi")


def align_input(inp: DataFrame, data: DataFrame, key: str = "dimx") -> DataFrame:
    """C-18: input rows that survived the data filters."""
    return inp.join(data.select(key), key, "left_semi")


def drop_nulls(df: DataFrame, subset=None) -> DataFrame:
    """C-16: drop rows with any missing value (NaN already NULL)."""
    return df.dropna("any", subset=subset)


def finite_rows(df: DataFrame, columns) -> DataFrame:
    """C-17: all chosen outputs finite."""
    return df.filter(all_of(is_finite(F.col(c)) for c in columns))


def approx_equal(c: Column, value: float, atol: float = 1e-5, rtol: float = 1e-3) -> Column:
    """C-22: ``np.isclose(a, v, atol, rtol)``."""
    return isclose(c, value, rtol=rtol, atol=atol)


# ---------------------------------------------------------------- zeroing (D-04 lives here: it is a chain step)

def negative_zero_columns(columns) -> list[str]:
    return N.columns_where(columns, lambda c: N.is_pure_heat(c) and N.is_flux(c))


def negative_to_zero(df: DataFrame, per_column: bool = False) -> DataFrame:
    """D-04: if any heat flux of a row is negative *or missing*, set all of them to 0.

    ``per_column=True`` clips each negative value on its own instead.
    """
    cols = negative_zero_columns(df.columns)
    if not cols:
        return df
    if per_column:
        repl = {c: F.when(F.col(c) < 0, F.lit(0.0)).otherwise(F.col(c)) for c in cols}
    else:
        # the row flag is computed once (a separate projection that Catalyst keeps apart because the flag is
        # used by every column) instead of once per column; as a loop over the columns, since one expression
        # a column grew the compiled method of the whole chain beyond what the JVM compiles
        bad = ~F.forall(F.array(*[F.col(c).cast("double") for c in cols]), lambda v: true_or_false(v >= 0))
        df = df.withColumn("__neg", bad)
        repl = {c: F.when(F.col("__neg"), F.lit(0.0)).otherwise(F.col(c)) for c in cols}
        return df.withColumns(repl).drop("__neg")
    return df.withColumns(repl)


# ---------------------------------------------------------------- stored filters

def create_stored_filter(df: DataFrame, pred: Pred, path: str, key: str = "dimx") -> None:
    """C-12: persist the ids that the predicate would *remove*."""
    df.filter(~pred(df)).select(key).write.mode("overwrite").parquet(path)


def load_stored_filter(spark, path: str):
    """C-13: the stored ids, or None when absent."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path)      # any other failure is raised: a filter must not be silently off


def apply_stored_filter(df: DataFrame, removed: DataFrame, key: str = "dimx") -> DataFrame:
    """C-14: ``index.difference(stored)`` as an anti join (AQE broadcasts it when small)."""
    return df.join(removed.select(key), key, "left_anti")


# ---------------------------------------------------------------- sanity chain

@dataclass
class Step:
    name: str
    pred: Pred | None = None                      # row filter
    transform: Callable[[DataFrame], DataFrame] | None = None   # row-local rewrite
    stored: DataFrame | None = None               # ids to drop instead of the predicate
    zero_row: bool = False                        # D-04 whole-row zeroing


@dataclass
class SanityChain:
    """C-15 as data: ordered steps, folded into one plan (or one report aggregate)."""
    steps: list[Step] = field(default_factory=list)

    def apply(self, df: DataFrame, key: str = "dimx") -> DataFrame:
        """All steps as one plan: the pushed range tests, then one cumulative flag and a single filter."""
        if any(s.stored is not None for s in self.steps):
            return self.apply_stepwise(df, key)
        # range tests on columns that no step rewrites go first, as bare comparisons the scan can take over
        rewritten = set(negative_zero_columns(df.columns)) if any(s.zero_row for s in self.steps) else set()
        early, rest, moving = [], [], any(s.transform is not None for s in self.steps)
        for s in self.steps:
            plain = not moving and s.pred is not None and hasattr(s.pred, "plain") and not s.pred.reads & rewritten
            (early if plain else rest).append(s)
        if early:
            df = df.filter(all_of(c for s in early for c in s.pred.plain()))
        flagged, names = SanityChain(rest).flags(df, key)
        if not names:
            return flagged
        # The flags are computed once per row in one projection.  The optimizer would push the last
        # filter below it, substituting every flag into one predicate too large to compile; it keeps a
        # filter on a column above the projection that reads the task's partition number.
        helper = [c for c in flagged.columns if c.startswith("__alive_")] + ["__part"]
        return flagged.withColumn("__part", F.spark_partition_id()) \
            .filter((F.col("__part") >= 0) & F.col(f"__alive_{names[-1]}")).drop(*helper)

    def apply_stepwise(self, df: DataFrame, key: str = "dimx") -> DataFrame:
        for s in self.steps:
            if s.zero_row:
                df = negative_to_zero(df)
            elif s.transform is not None:
                df = s.transform(df)
            elif s.stored is not None:
                df = apply_stored_filter(df, s.stored, key)
            else:
                df = df.filter(s.pred(df))
        return df

    def flags(self, df: DataFrame, key: str = "dimx") -> tuple[DataFrame, list[str]]:
        """The input with one cumulative ``__alive_<step>`` flag per filter step.

        Whole-row zeroing (D-04) is a projection of its own: the zeroed columns are read several times, so the optimizer
        keeps it apart from the predicates, which then see each value once.  Testing both the zeroed and the given
        values in one expression made the compiled method too large for the JVM, which interpreted it row by row.
        """
        alive = F.lit(True)
        names = []
        for s in self.steps:
            if s.zero_row:
                df = negative_to_zero(df)
                continue
            if s.transform is not None:
                df = s.transform(df)
                continue
            if s.stored is not None:
                hit = s.stored.select(F.col(key), F.lit(True).alias(f"__drop_{s.name}"))
                df = df.join(hit, key, "left")
                ok = F.col(f"__drop_{s.name}").isNull()
            else:
                ok = s.pred(df)
            alive = alive & ok
            col = f"__alive_{s.name}"
            df = df.withColumn(col, alive)
            alive = F.col(col)
            names.append(s.name)
        return df, names


def sanity_chain(septot_factor: float, ambi_bound: float, femto_bound: float,
                 cke_bound: float = INF, cki_bound: float = INF, ceke_bound: float = INF,
                 ceki_bound: float = INF, ambipolar_version: int = 1, stored: dict | None = None,
                 per_column_zero: bool = False) -> SanityChain:
    """C-15 in the reference's order: cke, cki, ceke, ceki (finite bounds only), zeroing, septot,
    ambipolar, femtoflux.  ``stored`` maps a step name to a DataFrame of ids to drop."""
    stored = stored or {}
    steps = []
    for name, bound, mk in (("cke", cke_bound, cke_ok), ("cki", cki_bound, cki_ok),
                            ("ceke", ceke_bound, ceke_ok), ("ceki", ceki_bound, ceki_ok)):
        if bound != INF and bound == bound:
            steps.append(Step(name, mk(bound), stored=stored.get(name)))
    if "negative" in stored:
        steps.append(Step("negative", stored=stored["negative"]))
    else:
        if per_column_zero:
            steps.append(Step("negative", transform=lambda d: negative_to_zero(d, True)))
        else:
            steps.append(Step("negative", zero_row=True))
    steps.append(Step("septot", septot_ok(septot_factor), stored=stored.get("septot")))
    steps.append(Step("ambipolar", ambipolar_ok(ambi_bound, ambipolar_version), stored=stored.get("ambipolar")))
    steps.append(Step("femtoflux", femtoflux_ok(femto_bound), stored=stored.get("femtoflux")))
    return SanityChain(steps)


def sanity_filter(df: DataFrame, septot_factor: float, ambi_bound: float, femto_bound: float,
                  **kw) -> DataFrame:
    return sanity_chain(septot_factor, ambi_bound, femto_bound, **kw).apply(df)


def sanity_chain_gen2(ck_bound: float, septot_factor: float, ambi_bound: float, femto_bound: float) -> SanityChain:
    """C-15 gen2 order: negative, ck, septot, ambipolar (v0), femto; all row filters."""
    return SanityChain([
        Step("negative", nonnegative_ok("gen2")),
        Step("ck", ck_ok(ck_bound)),
        Step("septot", septot_ok(septot_factor, "gen2")),
        Step("ambipolar", ambipolar_ok(ambi_bound, 0)),
        Step("femtoflux", femtoflux_ok(femto_bound, "gen2")),
    ])


#: C-19: name -> predicate factory, and the bounds that a filter without one takes.
FILTER_FUNCTIONS: dict[str, Callable[..., Pred]] = {
    "negative": lambda *a: nonnegative_ok(*a),
    "ck": ck_ok, "cke": cke_ok, "cki": cki_ok, "cek": cek_ok, "ceke": ceke_ok, "ceki": ceki_ok,
    "septot": septot_ok, "ambipolar": ambipolar_ok, "femtoflux": femtoflux_ok, "regime": regime_ok,
}
FILTER_DEFAULTS = {"ck": 50.0, "septot": 1.5, "ambipolar": 1.5, "femtoflux": 1e-4}


def register_filter(name: str, factory: Callable[..., Pred], default=None) -> None:
    """C-19: add a filter of one's own under a new name."""
    if name in FILTER_FUNCTIONS:
        raise ValueError(f"there is a filter {name!r}")
    FILTER_FUNCTIONS[name] = factory
    if default is not None:
        FILTER_DEFAULTS[name] = default


def apply_named(df: DataFrame, names) -> DataFrame:
    """C-19: filters by name, in order: a list of names, or a mapping to arguments (None: the default; a tuple: several)."""
    for name, arg in (names.items() if isinstance(names, dict) else ((n, None) for n in names)):
        if name not in FILTER_FUNCTIONS:
            raise KeyError(f"no filter {name!r}; there are {sorted(FILTER_FUNCTIONS)}")
        arg = FILTER_DEFAULTS.get(name) if arg is None else arg
        args = () if arg is None else arg if isinstance(arg, tuple) else (arg,)
        df = apply(df, FILTER_FUNCTIONS[name](*args))
    return df
