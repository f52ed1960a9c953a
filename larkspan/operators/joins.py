"""Joins with tables whose size is measured first.

A table of at most ``BROADCAST_ROWS`` rows goes to every executor. A larger one meets the rows by
shuffle, each of its rows under ``SALTS`` keys, so that a key that holds a large part of the rows is
dealt to as many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of short columns (names, numbers) that are broadcast at most.
BROADCAST_ROWS = 200_000
SALTS = 16


def is_small(table: DataFrame, rows: int | None = None) -> bool:
    """Whether the table has at most ``rows`` rows; no more than that are counted."""
    rows = BROADCAST_ROWS if rows is None else rows
    return table.limit(rows + 1).count() <= rows


def measured_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", small: bool | None = None) -> DataFrame:
    """``left`` joined with ``right`` (inner, left, left_semi or left_anti); ``spread`` deals rows of ``left`` that share a key."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how!r}")
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(right), on, how)
    taken = {c.lower() for c in (*left.columns, *right.columns)}
    salt = next(name for name in ("salt" + "_" * k for k in range(len(taken) + 1)) if name not in taken)
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(F.lit(5), spread), F.lit(SALTS)))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return dealt.join(copies, [*on, salt], how).drop(salt)
