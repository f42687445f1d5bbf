"""Dimension lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.operators.ranking import asc, top1_per_group


DEALS = 4096


def dealt(df: DataFrame) -> Column:
    """A number from 1 to ``DEALS`` by the row's own values, for rows that a left join would all send to one task.

    The same in a retried task; maps and variants have no hash and are left out.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()
             and "variant" not in f.dataType.simpleString()]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(DEALS)) + 1


def keyed_dimension(dim: DataFrame, key: str, outputs: dict[str, str], order: str | None = None,
                    prefix: str = "__d") -> DataFrame:
    """Dimension reduced to one row per lower-cased key, columns renamed ``outputs`` (dim col -> out)."""
    d = dim.select(F.lower(F.col(key)).alias(f"{prefix}_key"),
                   *[F.col(src).alias(dst) for src, dst in outputs.items()],
                   *([F.col(order).alias(f"{prefix}_ord")] if order else []))
    d = d.filter(F.col(f"{prefix}_key").isNotNull())
    d = top1_per_group(d, [f"{prefix}_key"], [asc(f"{prefix}_ord" if order else f"{prefix}_key")])
    return d.drop(f"{prefix}_ord") if order else d


def dim_lookup(df: DataFrame, dim: DataFrame, left_col: str, dim_key: str, outputs: dict[str, str],
               order: str | None = None, prefix: str = "__d") -> DataFrame:
    """Case-insensitive left lookup: ``lower(df.left_col) = lower(dim.dim_key)``.

    The dimension is first reduced to one row per lowered key (so the lookup
    can never multiply fact rows); how it is joined is left to the optimizer.
    """
    d = keyed_dimension(dim, dim_key, outputs, order, prefix)
    k = f"{prefix}_key"
    return df.join(d, F.lower(df[left_col]) == d[k], "left").drop(k)
