"""Joins and numbering that keep hot keys apart: no key, however common, is the work of one task."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; so there are fewer hot keys than the reciprocal, and they are broadcast.
HOT_SHARE, HOT_LEAST = 1 / 10_000, 5_000


def join_many(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows joined with a lookup of unique keys; `weight` (a lookup column) is the number of rows with the key.

    The lookup rows of hot keys are broadcast (fewer than 10,000 by the arithmetic of shares), so that their rows stay
    where they are; all others meet in a shuffled join. Both frames are read twice: hand in materialized ones.
    """
    total = lookup.agg(F.sum(weight)).first()[0] or 0
    floor = max(HOT_LEAST, int(total * HOT_SHARE))
    hot = lookup.where(F.col(weight) > floor)
    if hot.isEmpty():
        return rows.join(lookup, on, how)
    keys = F.broadcast(hot.select(*on))
    cold = rows.join(keys, on, "left_anti").join(lookup.where(F.col(weight) <= floor), on, how)
    return cold.unionByName(rows.join(F.broadcast(hot), on).select(*cold.columns))


def in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Rows range-partitioned and sorted: those of one key lie in neighbouring partitions, and are as many tasks' work."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def run_places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: the first row of each row's run of equal keys, and the row's place in it, from 0."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    return start, np.arange(n) - start


def before(parts: Iterable[tuple], add) -> dict:
    """{(key, part): what `add` folds over the parts of the key before it}, from rows (key, part, value); None for none."""
    out, held, last = {}, None, object()
    for key, part, value in sorted(parts, key=lambda r: (r[0], r[1])):
        if key != last:
            held, last = None, key
        out[key, part] = held
        held = add(held, value)
    return out
