"""Vector columns: which rows take part, and their Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Whether a vector is not null, not empty, not zero and all its components are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equally long lists without nulls as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def dimension(vectors: DataFrame, vector: str) -> int:
    """The width that most vectors have, the larger of equally frequent ones; 0 without any.
    One row a width reaches the driver."""
    widths = vectors.groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
    best = widths.orderBy(F.col("n").desc(), F.col("width").desc()).first()
    return best["width"] if best else 0
