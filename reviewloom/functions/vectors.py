"""Column expressions on vectors kept as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SCORE_DECIMALS = 6


def l2_normalise(v: Column) -> Column:
    """Unit-length vector of floats; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<float>")).otherwise(
        F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
    )


def inner_product(a: Column, b: Column) -> Column:
    """Dot product, summed in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(rows, -1) if rows else np.empty((0, 1))
