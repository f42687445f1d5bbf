"""IPv4 helpers: dotted quad <-> BIGINT and CIDR bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
IPV6_PATTERN = r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$"


def ipv4_to_long(ip: Column) -> Column:
    """Dotted IPv4 -> BIGINT; NULL for anything that is not an IPv4 literal."""
    parts = [F.regexp_extract(ip, IPV4_PATTERN, i).try_cast("bigint") for i in range(1, 5)]
    ok = ip.rlike(IPV4_PATTERN)
    return F.when(ok, ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3])


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """'a.b.c.d/p' -> (first, last) address as BIGINT."""
    base = ipv4_to_long(F.substring_index(cidr, "/", 1))
    size = F.pow(F.lit(2), F.lit(32) - F.substring_index(cidr, "/", -1).cast("int")).cast("bigint")
    lo = base - F.pmod(base, size)
    return lo, lo + size - 1
