"""Vectors as whole numbers: which rows take part, and their components as floor(256 * x)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are whole numbers below this in size, so that squared distances and products of up to 64 of them fit 64 bits.
MOST = 1 << 27


def takes_part(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector is there, holds no null and no non-finite component, and (where ``dims`` is given) has so many."""
    good = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    return good if dims is None else good & (F.size(vector) == dims)


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component x, as int. Sizes of ``MOST`` or more end the query with an error, as their sums might not fit."""
    return F.transform(vector, lambda v: F.when(F.abs(v.cast("double")) * 256 < MOST, F.floor(v.cast("double") * 256).cast("int")).otherwise(F.raise_error(F.lit("a component is too large")).cast("int")))


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow column of int lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
