"""Stable keys: the same integer for the same value on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_key(c: Column | str) -> Column:
    """60-bit non-negative integer taken from the md5 of the value's text."""
    return F.conv(F.substring(F.md5(_col(c).cast("string")), 1, 15), 16, 10).cast("bigint")


def stable_pair(c: Column | str) -> tuple[Column, Column]:
    """Two 60-bit non-negative integers from the md5 of the value's text; the first is ``stable_key``."""
    digest = F.md5(_col(c).cast("string"))
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint") for at in (1, 16))


def seeded_rank_key(seed: int, *cols: Column | str) -> Column:
    """Text that orders rows pseudo-randomly but reproducibly for a seed."""
    parts = [_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *parts))


def content_digest(c: Column | str) -> Column:
    """SHA-256 of a text, as hex."""
    return F.sha2(_col(c), 256)
