"""Vectors as whole numbers floor(scale * x), and exact sums of them over all rows.

Where every sum of squared differences fits 64 bits, numbers are int64; rows beyond that hold Python's integers, so no
value of a double is too large. Totals leave a task as limbs of 40 bits, one row each, which Spark adds up as longs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 40
LONG = 2**63


def finite(vector: str | Column) -> Column:
    """True for a vector that is not null and holds only finite components; null vectors give false."""
    inf = F.lit(float("inf"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != inf))
    return F.coalesce(good, F.lit(False))


def dense(column: pa.Array, width: int, pad: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their components as doubles): rows of `width` components, or with pad of at most `width`
    followed by zeros; null rows, null and non-finite components make a row unusable."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    usable = ((lengths >= 0) & (lengths <= width)) if pad else lengths == width
    flat = column.filter(pa.array(usable)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = np.zeros((int(usable.sum()), width))
    x[np.arange(width) < lengths[usable][:, None]] = flat
    good = np.isfinite(x).all(axis=1)
    usable[usable] = good
    return usable, x[good]


def limit(width: int) -> int:
    """Up to this magnitude, squared differences of `width` whole numbers add up within 62 bits."""
    return 2 ** ((62 - math.ceil(math.log2(max(width, 2)))) // 2 - 1)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), scale a power of two: int64 where limit() holds for all, else Python's integers."""
    if not x.size or np.abs(x).max() < limit(x.shape[1]) / scale:
        return np.floor(x * scale).astype(np.int64)
    return np.array([[int(v) * scale if abs(v) >= 2**53 else math.floor(v * scale) for v in row] for row in x.tolist()], dtype=object)


def in_groups(x: np.ndarray, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of rows, their whole numbers), rows beyond limit() apart from the others."""
    large = np.abs(x).max(axis=1, initial=0) >= limit(x.shape[1]) / scale
    for rows in (np.flatnonzero(~large), np.flatnonzero(large)):
        if len(rows):
            yield rows, whole(x[rows], scale)


def as_array(numbers: list) -> np.ndarray:
    """A matrix of Python's integers, as int64 where limit() allows."""
    wide = np.array(numbers, dtype=object)
    small = not wide.size or max(abs(v) for v in wide.ravel()) <= limit(wide.shape[-1])
    return wide.astype(np.int64) if small else wide


def alike(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as Python's integers where either is."""
    return (x, c) if x.dtype == c.dtype else (x.astype(object), c.astype(object))


def doubles(x: np.ndarray) -> np.ndarray:
    """The nearest doubles; infinite near the end of their range."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 2**1000 else np.inf for v in x.ravel().tolist()], dtype=np.float64).reshape(x.shape)


def or_null(numbers) -> list:
    """Numbers that fit a long, null for others."""
    return [int(v) if v < LONG else None for v in numbers]


TOTALS = "slot int, limb int, total long"


def limbs(totals: np.ndarray) -> pa.RecordBatch:
    """Rows of TOTALS: slot is the place of a number in totals."""
    rows = []
    for slot, v in enumerate(totals.tolist()):
        sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
        while v:
            rows.append((slot, limb, sign * (v & ((1 << LIMB) - 1))))
            v, limb = v >> LIMB, limb + 1
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["slot", "limb", "total"])


def added(parts: DataFrame, size: int) -> np.ndarray:
    """The totals of all tasks; `size` numbers of a few limbs come to the driver, whatever the rows."""
    out = np.zeros(size, dtype=object)
    for slot, limb, total in parts.groupBy("slot", "limb").agg(F.sum("total")).collect():
        out[slot] += total << (LIMB * limb)
    return out
