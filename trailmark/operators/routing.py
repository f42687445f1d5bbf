"""Row routing: regex keep/drop filters, stream tagging and good/bad splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regex_field_filter(df: DataFrame, field: str, pattern: str, action: str = "keep") -> DataFrame:
    """Keep (or drop) rows whose ``field`` matches ``pattern``; NULL never matches."""
    m = F.coalesce(F.col(field).rlike(pattern), F.lit(False))
    return df.filter(m if action == "keep" else ~m)
