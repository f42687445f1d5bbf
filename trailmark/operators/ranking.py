"""Top-1-per-key and ranking helpers.

``top1_per_group`` is the ``row_number() = 1`` pattern.  Catalyst turns the
filter into a ``WindowGroupLimit`` that also runs *before* the shuffle, so a
hot key (one event id repeated by a third of all rows) is cut down to one row
per map task before it is exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asc(c) -> Column:
    """Ascending, NULLs last (the SQL-engine default the model was written for)."""
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def desc(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_last()


def top1_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                   rn_col: str = "__rn") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn_col, F.row_number().over(w)).filter(F.col(rn_col) == 1).drop(rn_col)


def dedupe_events(df: DataFrame) -> DataFrame:
    """One row per event_id, the earliest by collector then device time (ties: least row hash).

    The hash makes the surviving copy the same in a retried task.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()
             and "variant" not in f.dataType.simpleString()]
    return top1_per_group(df, ["event_id"], [asc("collector_tstamp"), asc("dvce_created_tstamp"),
                                             F.xxhash64(*plain).asc()])


def dedupe_dimension(dim: DataFrame, key: str, order: str = "name") -> DataFrame:
    """One row per (lower-cased) dimension key, first by ``order``."""
    return (top1_per_group(dim.withColumn("__k", F.lower(F.col(key))), ["__k"], [asc(order)])
            .drop("__k"))


def rank_in_group(df: DataFrame, group: str, ts_col: str, order: Sequence[Column], out: str,
                  count_out: str | None = None, bucket_seconds: int = 60, then_col: str | None = None) -> DataFrame:
    """``row_number() over (partition by group order by ts_col, ...)`` without sorting a group in one task.

    ``order`` must start with ``ts_col`` ascending, NULLs last, then ``then_col`` likewise if given.  The input is
    written once and read from there.  Rows are cut into (group, time bucket) slices, those without time by their
    bucket of ``then_col``; each slice is ranked on its own (hash-partitioned on both keys, so a hot group spreads
    over many tasks), then shifted by the row count of the group's earlier slices, which a second pass over the two
    or three key columns counts.  ``count_out`` adds the group size (the whole-partition max of the rank).
    """
    from trailmark.functions.timeutil import epoch_micros, floor_div
    from trailmark.session import materialize

    big = F.lit(9_223_372_036_854_775_807)

    def bucket(col):
        return F.coalesce(floor_div(epoch_micros(F.col(col)), bucket_seconds * 1_000_000), big)

    later = F.when(F.col(ts_col).isNull(), bucket(then_col)) if then_col else F.lit(None).cast("bigint")
    d = materialize(df.withColumns({"__slice": bucket(ts_col), "__then": F.coalesce(later, F.lit(0).cast("bigint"))}),
                    "rank_input")
    slices = ["__slice", "__then"]
    counts = d.groupBy(group, *slices).agg(F.count(F.lit(1)).alias("__n"))
    w_prev = Window.partitionBy(group).orderBy(*slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w_prev), F.lit(0)))
    if count_out:
        offsets = offsets.withColumn(count_out, F.sum("__n").over(Window.partitionBy(group)))
    offsets = offsets.drop("__n")
    local = d.withColumn("__local", F.row_number().over(Window.partitionBy(group, *slices).orderBy(*order)))
    same = local[group].eqNullSafe(offsets[group])
    for c in slices:
        same = same & (local[c] == offsets[c])
    j = local.join(offsets, same).drop(offsets[group], *[offsets[c] for c in slices])
    return j.withColumn(out, (F.col("__off") + F.col("__local")).cast("bigint")).drop(*slices, "__local", "__off")


def running_total_in_group(df: DataFrame, group: str, ts_col: str, order: Sequence[Column], value: Column,
                           out: str, slice_seconds: int = 1) -> DataFrame:
    """Running ``sum(value)`` per group in ``order`` (rows frame), split into time slices.

    Same technique as :func:`rank_in_group`: per-slice running sums plus the
    total of the group's earlier slices, so a hot group is spread over tasks.
    ``order`` must start with ``ts_col`` ascending, NULLs last.
    """
    from trailmark.functions.timeutil import epoch_micros, floor_div

    big = F.lit(9_223_372_036_854_775_807)
    d = df.withColumn("__slice", F.coalesce(floor_div(epoch_micros(F.col(ts_col)), slice_seconds * 1_000_000), big)) \
        .withColumn("__val", value)
    totals = d.groupBy(group, "__slice").agg(F.sum("__val").alias("__tot"))
    w_prev = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("__off", F.coalesce(F.sum("__tot").over(w_prev), F.lit(0))).drop("__tot")
    w_local = Window.partitionBy(group, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = d.withColumn("__run", F.sum("__val").over(w_local))
    j = local.join(offsets, local[group].eqNullSafe(offsets[group]) & (local["__slice"] == offsets["__slice"]))
    j = j.drop(offsets[group]).drop(offsets["__slice"])
    return j.withColumn(out, F.col("__off") + F.col("__run")).drop("__slice", "__val", "__run", "__off")
