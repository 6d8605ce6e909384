"""Joins in which one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a key is heavy, and heavy keys up to which they are broadcast (some dozen bytes each).
HEAVY, BROADCAST = 1_000_000, 1_000_000


def semi_join(rows: DataFrame, known: DataFrame, keys: list[str], weight: str, heavy: int = HEAVY, most: int = BROADCAST) -> DataFrame:
    """The rows whose keys are among ``known``, where each key stands once with the number of its rows (or of documents) in ``weight``.

    Heavy keys are looked up where the rows are, by broadcast, so none of their rows is shuffled; there are at most as
    many as rows / ``heavy``, and their number is checked. The other keys are joined as usual. known is read twice, so
    it should be checkpointed.
    """
    big = known.where(F.col(weight) >= heavy).select(*keys)
    n = big.limit(most + 1).count()
    if n == 0 or n > most:  # nothing is heavy, or too much to be sent: then adaptive execution splits what is skewed
        return rows.join(known.select(*keys), keys, "left_semi")
    light = known.where(F.col(weight) < heavy).select(*keys)
    rest = rows.join(F.broadcast(big), keys, "left_anti").join(light, keys, "left_semi")
    return rows.join(F.broadcast(big), keys, "left_semi").unionByName(rest)
