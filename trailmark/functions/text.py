"""String predicates with the exact matching rules of the model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_match(col: Column, pattern: str) -> Column:
    """Whole-string, case-sensitive regex match (the SIMILAR TO rule).

    ``(?d)`` makes ``.`` stop only at ``\\n``, like RE2; NULL input gives NULL.
    """
    return col.rlike(f"(?d)\\A(?:{pattern})\\z")


def norm(col: Column) -> Column:
    """lower(trim(x)) -- trim removes spaces only."""
    return F.lower(F.trim(col))


def query_param(query: Column, name: str, decode: bool = True) -> Column:
    """Value of ``name`` in an ``a=1&b=2`` query string; NULL when absent.

    The first occurrence wins.  Values are form-decoded ('+' is a space,
    ``%xx`` escapes); an undecodable value is kept as it is.
    """
    prefix = f"{name}="
    # first '&'-separated item starting with 'name=' (no regex per row); NULL when absent
    hit = F.get(F.filter(F.split(query, "&"), lambda item: item.startswith(prefix)), 0)
    raw = F.substring_index(F.substring(hit, len(prefix) + 1, 1 << 30), "#", 1)
    return F.coalesce(F.try_url_decode(raw), raw) if decode else raw
