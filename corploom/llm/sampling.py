"""Bounded samples that cover a whole table evenly, chosen by a hash, without an order over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Bytes up to which texts are taken into samples for fitting, which bounds what reaches the driver: rows times this.
LONGEST = 65_536


def place(*keys: str) -> Column:
    """A hash of the keys as a fraction from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def short(text: str = "text") -> Column:
    """Whether a text may be in a sample."""
    return F.octet_length(text) <= LONGEST


def sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """About ``n`` rows of df (all, if it has fewer): those whose hash is below n / rows. Never more than 2 n.

    The rows are counted first, so only rows of the sample leave their tasks, whatever the number of partitions.
    """
    total = df.count()
    if total <= n:
        return df
    return df.where(place(*keys) < F.lit(n / total)).limit(2 * n)
