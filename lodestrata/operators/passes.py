"""Sums over all rows, for fits that go over the data again and again: a task adds up numbers of its own Arrow batches,
Spark adds up the tasks, and only the totals, whose number depends on the model alone, come to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The columns of a batch as doubles; null is NaN."""
    columns = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]
    return np.column_stack(columns) if columns else np.zeros((batch.num_rows, 0))


def totals(df: DataFrame, columns: list[str], measure: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """measure gives `size` numbers of a matrix of rows (columns in the order given); their sums over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += measure(matrix(batch))
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(total[slots])], names=["slot", "total"])

    out = np.zeros(size)
    parts = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in columns]).mapInArrow(run, "slot int, total double")
    sums = parts.groupBy("slot").agg(F.sum("total").alias("total")).toPandas()
    out[sums["slot"].to_numpy()] = sums["total"].to_numpy()
    return out


def scored(df: DataFrame, columns: list[str], score: Callable[[np.ndarray], dict[str, np.ndarray]], fields: dict[str, T.DataType]) -> DataFrame:
    """df with further columns, which score gives of a matrix of rows; a matrix it gives is a column of arrays."""
    schema = T.StructType([T.StructField("row", df.schema), *[T.StructField(k, v) for k, v in fields.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(matrix(batch.select(range(1, batch.num_columns))))
            arrays = [pa.array(list(v), pa.list_(pa.float64())) if v.ndim == 2 else pa.array(v, pa.float64()) for v in (found[k] for k in fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *fields])

    rows = df.select(F.struct("*").alias("row"), *[F.col(f"`{c}`").cast("double").alias(f"_{i}") for i, c in enumerate(columns)])
    return rows.mapInArrow(run, schema).select("row.*", *fields)


def quadratic(x: np.ndarray, weight: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    """The sums of weight * x_i * y_j, flat; y is x unless given."""
    return (x.T @ ((x if y is None else y) * weight[:, None])).ravel()


def chi_square_tail(x: float, df: int) -> float:
    """The share of a chi-square law of `df` degrees above x."""
    import math

    if x <= 0 or df <= 0:
        return 1.0
    half = x / 2
    if df % 2:
        total, term, k = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5), 1.5
    else:
        total, term, k = 0.0, math.exp(-half), 1.0
    while k <= df / 2:  # Q(k + 1) = Q(k) + half^k e^-half / k!
        total, term, k = total + term, term * half / k, k + 1
    return min(1.0, total)
