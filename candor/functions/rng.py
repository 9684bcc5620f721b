"""Uniform numbers from a counter: the same in every engine, run and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(c: Column, at: int = 1, digits: int = 8) -> Column:
    """Some hexadecimal digits of the MD5 as a number."""
    return F.conv(F.substring(F.md5(c.cast("binary")), at, digits), 16, 10).cast("long")


def uniform(seed: str, *ids: Column | str) -> Column:
    """In [0, 1), from the seed and the ids."""
    key = F.concat_ws("|", F.lit(seed), *[(F.col(i) if isinstance(i, str) else i).cast("string") for i in ids])
    return hash32(key).cast("double") / F.lit(4294967296.0)
