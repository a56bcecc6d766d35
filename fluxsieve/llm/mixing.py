"""Mixing sources to target weights by a time-varying curriculum (operator 7, native).

Each source has a weight schedule over training time 0..1, piecewise linear between shared
knots.  Its integral is the source's weight: all sizes times ``factor`` are shared among the
sources by weight, no source taking more than ``repeats`` times its size; what is above goes to
the others by weight until none is above.

Within a source the documents stand in a fixed random order (MD5 of the id); passes over that
order meet the target.  A document's place in its source's cumulative demand is turned into a
training position by inverting the integral of the source's schedule: a source with a falling
schedule is read mostly early, one with a rising schedule late.  The mix is range-sorted by
position.

Prefix sums need no window over a whole source: a source is cut into 4096 buckets of the order,
bucket totals are summed first, and rows only within their bucket.  Only the table of sources
(one row each) is ordered in one task.

Defined results: a null text has size 0 and a null source is a source of its own, last in order;
documents of size 0 take nothing; null ids stand first in their source's order.  Equal rows are
told apart by nothing, so which of them takes one copy more does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Default schedules at times 0, 1/2, 1, repeating over the sources: integrals 5, 2 and 1.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((7.5, 5.0, 2.5), (2.0, 2.0, 2.0), (0.5, 1.0, 1.5))
#: White space that separates words: space and 0x09-0x0D.
WHITE = "\t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space (0 for null)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def integrals(knots, values) -> list[float]:
    """Integral of a schedule from time 0 to each knot."""
    out = [0.0]
    for (t0, w0), (t1, w1) in zip(zip(knots, values), zip(knots[1:], values[1:])):
        out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
    return out


def inverse_demand(share: Column, which: Column, knots, schedules) -> Column:
    """Time at which the integral of schedule number ``which`` reaches ``share`` (0..1) of its total."""
    out = F.lit(None).cast("double")
    for s, values in enumerate(schedules):
        at = integrals(knots, values)
        y = share * at[-1]
        time = F.lit(float(knots[-1]))
        for k in range(len(knots) - 2, -1, -1):
            width, a, b = knots[k + 1] - knots[k], values[k], values[k + 1]
            if at[k + 1] <= at[k]:
                continue
            part = F.greatest(F.lit(0.0), (y - at[k]) / width)       # mean-weight units used inside the segment
            root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2.0 * (b - a)) * part))
            inside = F.when(part > 0, 2.0 * part / (F.lit(float(a)) + root)).otherwise(0.0)
            time = F.when(y < at[k + 1], knots[k] + width * F.least(F.lit(1.0), inside)).otherwise(time)
        out = F.when(which == s, time).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights, factor: float, repeats: float) -> DataFrame:
    """``sizes(no_source, source, source_size)`` with ``which`` (schedule number), ``target``."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("which", (F.row_number().over(Window.orderBy("no_source", "source")) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("which") + 1)) \
        .withColumn("cap", F.col("source_size") * float(repeats))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "no_source", "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn("total", F.sum("source_size").over(every) * float(factor)) \
        .withColumn("weights", F.sum("weight").over(every)) \
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    stops = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return level.withColumn("level", F.first(stops, ignorenulls=True).over(whole)) \
        .withColumn("target", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))) \
        .select("no_source", "source", "source_size", "which", "target")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry=(),
             knots=KNOTS, schedules=SCHEDULES, factor: float = 1.5, repeats: float = 2.0) -> DataFrame:
    """One row per document: struct ``doc`` (the columns in ``carry``, default the id), ``size``,
    ``source_size``, ``target`` (its source's), ``copies``, ``positions`` (training positions of the copies)."""
    weights = [integrals(knots, s)[-1] for s in schedules]
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = cut_lineage(docs.select(
        F.struct(*[F.col(c) for c in (carry or [id_col])]).alias("doc"),
        F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        key.alias("h"), F.substring(key, 1, 3).alias("slot"), word_count(F.col(text_col)).alias("size")))
    slots = sized.groupBy("no_source", "source", "slot").agg(F.sum("size").alias("n"))
    sources = source_targets(slots.groupBy("no_source", "source").agg(F.sum("n").alias("source_size")), weights, factor, repeats)
    earlier = Window.partitionBy("no_source", "source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n") \
        .join(sources, ["no_source", "source"])
    inside = Window.partitionBy("no_source", "source", "slot").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(slots, ["no_source", "source", "slot"]) \
        .withColumn("middle", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2.0)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    rest = F.col("target") - passes * F.col("source_size")
    copies = passes + F.when(F.col("middle") < rest, 1).otherwise(0)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0))
    at = [inverse_demand(F.least(F.lit(1.0), (F.col("middle") + k * F.col("source_size")) / F.col("target")),
                         F.col("which"), knots, schedules) for k in range(int(repeats) + 1)]
    return placed.withColumn("positions", F.slice(F.array(*at), 1, F.col("copies"))) \
        .select("doc", "h", "size", "source_size", "target", "copies", "positions")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The training set: ``docs`` (all columns), each row as often as it is taken, range-sorted by position."""
    cols = docs.columns
    plan = plan_mix(docs, id_col, text_col, source_col, carry=cols, **how)
    rows = plan.select("doc", "h", F.explode("positions").alias("position"))
    return rows.repartitionByRange("position", "h").sortWithinPartitions("position", "h") \
        .select(*[F.col("doc").getField(c).alias(c) for c in cols])


#: The same plan in DuckDB SQL, for the default schedules.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source, md5(coalesce(doc_id::varchar, '')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint AS size FROM documents),
src AS (SELECT no_source, source, sum(size)::bigint AS source_size FROM sized GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (ORDER BY no_source, source) - 1) % 3 AS which FROM src),
weighed AS (SELECT *, [5.0, 2.0, 1.0][which + 1]::double AS weight, source_size * 2.0::double AS cap FROM ranked),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::double - coalesce(sum(cap) OVER f, 0))
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
           FROM weighed WINDOW f AS (ORDER BY cap / weight, no_source, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stop AS (SELECT min_by(level, (cap / weight, no_source, source)) AS level FROM levels WHERE cap / weight >= level),
targets AS (SELECT no_source, source, source_size, which, least(cap, stop.level * weight) AS target FROM levels, stop),
placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.which,
                  coalesce(sum(s.size) OVER (PARTITION BY s.no_source, s.source ORDER BY s.h, s.size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0 AS middle
           FROM sized s JOIN targets t ON s.no_source = t.no_source AND s.source = t.source),
taken AS (SELECT *, CASE WHEN size > 0 THEN floor(target / source_size)
                    + CASE WHEN middle < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies
          FROM placed),
shares AS (SELECT *, least(1.0, middle / target) AS y FROM taken)
SELECT doc_id, size, source_size, target::double AS target, (copies * size)::bigint AS taken,
       CASE WHEN copies > 0 THEN CASE which
         WHEN 1 THEN y
         WHEN 0 THEN CASE WHEN y * 5 < 3.125 THEN 0.5 * (2 * (y * 10) / (7.5 + sqrt(56.25 - 5 * (y * 10))))
                     ELSE 0.5 + 0.5 * (2 * ((y * 5 - 3.125) * 2) / (5 + sqrt(greatest(0, 25 - 5 * ((y * 5 - 3.125) * 2))))) END
         ELSE CASE WHEN y < 0.375 THEN 0.5 * (2 * (y * 2) / (0.5 + sqrt(0.25 + (y * 2))))
              ELSE 0.5 + 0.5 * (2 * ((y - 0.375) * 2) / (1 + sqrt(1 + ((y - 0.375) * 2)))) END
       END END::double AS first_position
FROM shares
"""
