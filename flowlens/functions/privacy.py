"""Pseudonyms. The salt is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions.scalars import col


def pseudonym(ip: str | Column, salt: str) -> Column:
    """sha256 of "salt:ip" in hex; a missing address counts as 0.0.0.0."""
    ip = col(ip).cast("string")
    known = F.when(ip.isNull() | ip.isin("-", ""), F.lit("0.0.0.0")).otherwise(ip)
    return F.sha2(F.concat(F.lit(f"{salt}:"), known), 256)


def short_pseudonym(ip: str | Column, salt: str) -> Column:
    """The first 16 hex digits of the pseudonym."""
    return F.substring(pseudonym(ip, salt), 1, 16)


def indexed_pseudonym(ip: str | Column, salt: str) -> Column:
    """"sha256:" and 16 hex digits; null and empty stay as they are."""
    ip = col(ip).cast("string")
    return F.when(ip.isNull() | (ip == ""), ip).otherwise(F.concat(F.lit("sha256:"), F.substring(F.sha2(F.concat(F.lit(salt), ip), 256), 1, 16)))


def vendor_pseudonym(ip: str | Column, salt: str) -> Column:
    """Hashes what looks like an address; other names stay, nothing becomes "unknown"."""
    ip = col(ip).cast("string")
    return F.when(ip.isNull() | (ip == ""), F.lit("unknown")).when(ip.rlike("[.:]"), pseudonym(ip, salt)).otherwise(ip)


def is_pseudonym(value: str | Column) -> Column:
    value = col(value)
    return value.startswith("hash:") | (F.length(value) > 39) | value.rlike("^[0-9a-fA-F]{32,}$")
