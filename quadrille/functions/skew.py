"""Joins to one row per key that stay even when a few keys hold much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS, HOT_KEYS = 10_000, 100_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per ``key`` and its number of rows in ``count``.

    ``total`` is the number of rows. Keys with more than ``HOT_ROWS`` of them, of
    which there are at most ``HOT_KEYS`` at every size, go by a broadcast and never
    meet in one task; all others by an ordinary join. Null keys match nothing.
    """
    hot = facts.where(F.col(count) > max(HOT_ROWS, total // HOT_KEYS))
    spread = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts, key)
    return spread.unionByName(rest)
