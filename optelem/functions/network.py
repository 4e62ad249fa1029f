"""IPv4 arithmetic and URL parts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_to_long(ip: str) -> Column:
    """Dotted IPv4 to its number; anything else is NULL."""
    parts = F.split(F.col(ip), r"\.")
    octets = [F.try_element_at(parts, F.lit(i + 1)).try_cast("long") for i in range(4)]
    number = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    good = F.size(parts) == 4
    for o in octets:
        good = good & o.between(0, 255)
    return F.when(good, number)


def prefix16(number: Column) -> Column:
    return F.shiftright(number, 16)


def url_host(url: str) -> Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def host_suffixes(host: Column) -> Column:
    """The host and every domain above it, down to its last label."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
