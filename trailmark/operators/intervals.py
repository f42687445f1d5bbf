"""Lookup of numbers in intervals by equal keys.

An interval of integers is a union of aligned blocks, each a power of two long:
at most two of each length.  A number lies in the interval just if it lies in
one of those blocks, that is, if its leading bits equal the block's.  The
intervals become rows (length, leading bits), of which the best interval is kept
for each block, so that the list's side of the join is unique; each distinct
number looks up its leading bits once for each length in use.  There is no range
condition and no bucket that many intervals share, however dense they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.joins import dealt

BITS = 32


def blocks(intervals: DataFrame, lo: str = "lo", hi: str = "hi", bits: int = BITS) -> DataFrame:
    """``intervals`` with one row for each aligned block of theirs: ``__len`` (leading bits) and ``__prefix``.

    Intervals are closed, cut to 0 .. 2 ** bits - 1; empty and null ones have no blocks.
    """
    top = (1 << bits) - 1
    a, z = F.greatest(F.col(lo).cast("long"), F.lit(0)), F.least(F.col(hi).cast("long"), F.lit(top))
    ok = F.col(lo).isNotNull() & F.col(hi).isNotNull() & (F.col(lo) <= top) & (F.col(hi) >= 0)
    rows = intervals.filter(ok).withColumns({"__lo": a, "__hi": z}).filter("__lo <= __hi").withColumn(
        "__len", F.explode(F.sequence(F.lit(0), F.lit(bits))))
    size = f"shiftleft(1L, {bits} - __len)"
    ends = F.array_distinct(F.array(F.expr(f"(__lo + {size} - 1) div {size}"), F.expr(f"(__hi + 1) div {size} - 1")))
    inside = F.expr(f"__prefix * {size} >= __lo AND __prefix * {size} + {size} - 1 <= __hi")
    # a block whose double-sized parent lies inside too is part of that one
    parent = F.expr(f"__len > 0 AND (__prefix div 2) * 2 * {size} >= __lo AND ((__prefix div 2) + 1) * 2 * {size} - 1 <= __hi")
    return rows.withColumn("__prefix", F.explode(ends)).filter(inside & ~parent).drop("__lo", "__hi")


def points_in(points: DataFrame, intervals: DataFrame, number: str, outputs: list[str], lo: str = "lo", hi: str = "hi",
              bits: int = BITS) -> DataFrame:
    """For each different ``number``: it and ``outputs`` of the narrowest interval that holds it.

    Ties go to the smaller ``lo``, then to the least outputs in order, so that a run can be repeated.
    """
    order = F.struct((F.col(hi) - F.col(lo)).alias("w"), F.col(lo).alias("lo"), *outputs)
    best = blocks(intervals, lo, hi, bits).groupBy("__len", "__prefix").agg(F.min(order).alias("__best"))
    lengths = sorted(r["__len"] for r in best.select("__len").distinct().collect())  # bits + 1 values at most
    keys = F.explode(F.array(*[F.struct(F.lit(n).alias("__len"), F.shiftright(F.col(number), bits - n).alias("__prefix"))
                               for n in lengths])) if lengths else None
    asked = points.select(F.col(number).cast("long").alias(number)).filter(
        F.col(number).between(0, (1 << bits) - 1)).distinct()
    if keys is None:
        return asked.limit(0).select(number, *[F.lit(None).cast(intervals.schema[o].dataType).alias(o) for o in outputs])
    found = asked.withColumn("__k", keys).select(number, "__k.*").join(best, ["__len", "__prefix"])
    return found.groupBy(number).agg(F.min("__best").alias("__best")).select(number, *[f"__best.{o}" for o in outputs])


def lookup(df: DataFrame, intervals: DataFrame, number: Column, outputs: list[str], lo: str = "lo", hi: str = "hi",
           bits: int = BITS) -> DataFrame:
    """Left lookup: ``df`` with ``outputs`` of the narrowest interval around ``number`` (NULL where there is none).

    Rows without a number get one below 0, which no interval holds, each its own: nulls would all go to one task.  The
    intervals are asked for the plain numbers: a filter on a number that takes in the whole row would be pushed down and
    multiplied by the optimizer once for each column that it reads.
    """
    rows = df.drop(*[o for o in outputs if o in df.columns])
    near = points_in(rows.select(number.cast("long").alias("__point")), intervals, "__point", outputs, lo, hi, bits)
    rows = rows.withColumn("__point", F.coalesce(number.cast("long"), -dealt(rows)))
    return rows.join(near, "__point", "left").drop("__point")
