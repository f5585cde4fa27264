"""What operators on vectors share: which rows take part, and their components as arrays in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sound(v: Column) -> Column:
    """Whether a vector (array<double>) is there and holds neither null nor non-finite components."""
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def is_single(df: DataFrame, column: str) -> bool:
    kind = df.schema[column].dataType
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)


def numbers(df: DataFrame, column: str) -> Column:
    """The vectors of a column as array<float> where they are that, else as array<double>."""
    return df[column] if is_single(df, column) else df[column].cast("array<double>")


def rows_of(column: pa.Array) -> list[np.ndarray]:
    """The vectors of an Arrow list column without nulls."""
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
