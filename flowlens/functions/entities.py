"""Entities named in a text, and those that a text names beyond an allowed set."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.scalars import col

#: Patterns of addresses, of hashes that stand for addresses, of host names and of alert ids; boundaries are those of any letters.
IPV4 = r"(?U)\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
HEX = r"(?iU)\b[0-9a-f]{32,64}\b"
HOST = r"(?U)\b[A-Z][A-Z0-9-]{2,}(?:\.[A-Za-z0-9-]+)*\b"
ALERT_ID = r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"


def found(text: str | Column, pattern: str) -> Column:
    """Sorted distinct matches."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))))


def ips(text: str | Column) -> Column:
    """Addresses, and the hashes that stand for them once they are pseudonyms."""
    return F.array_sort(F.array_distinct(F.concat(found(text, IPV4), found(text, HEX))))


def hashes(text: str | Column) -> Column:
    return found(text, HEX)


def hosts(text: str | Column) -> Column:
    """Upper-case names of at least three characters, with what follows them after dots."""
    return found(text, HOST)


def unsupported(named: str | Column, allowed: str | Column) -> Column:
    """What is named but not allowed: entities that an explanation made up."""
    return F.array_except(col(named), col(allowed))


def alert_ids(text: str | Column) -> Column:
    return found(text, ALERT_ID)


def invented(text: str | Column, ips_: str | Column, hosts_: str | Column, ids: str | Column) -> Column:
    """What a text names that its input does not have: struct of arrays of addresses, host names and alert ids."""
    return F.struct(unsupported(ips(text), ips_).alias("ips"), unsupported(hosts(text), hosts_).alias("hosts"), unsupported(alert_ids(text), ids).alias("alert_ids"))
