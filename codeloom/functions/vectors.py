"""Vector expressions and the built-in text embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.binding import bind
from codeloom.functions.text import words

DEFAULT_DIM = 1024
# Rows whose counts are held in memory together.
ROWS_AT_ONCE = 1024


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def l2_normalize(vector: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return bind(
        l2_norm(vector),
        lambda n: F.transform(
            vector, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)
        ),
    )


def hash_buckets(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """One bucket number per word: leading 32 bits of its md5, modulo ``dim``."""
    return F.transform(
        words(text),
        lambda w: F.pmod(
            F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(dim)
        ).cast("int"),
    )


def _unit_counts(dim: int):
    def of_rows(buckets: pa.Array) -> np.ndarray:
        n = len(buckets)
        rows = np.repeat(np.arange(n, dtype=np.int64), np.asarray(buckets.value_lengths()))
        cells = rows * dim + np.asarray(buckets.flatten(), dtype=np.int64)
        counts = np.bincount(cells, minlength=n * dim).reshape(n, dim).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        return np.divide(counts, norms, out=counts, where=norms > 0).astype(np.float32)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def unit_counts(buckets: pa.Array) -> pa.Array:
        parts = [of_rows(buckets.slice(at, ROWS_AT_ONCE)) for at in range(0, len(buckets), ROWS_AT_ONCE)]
        offsets = np.arange(len(buckets) + 1, dtype=np.int32) * dim
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).ravel()))

    return unit_counts


def embed_text(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Built-in embedding: hashed word counts, scaled to unit length.

    Words are split and hashed in the JVM; one Arrow pass per batch counts them.
    """
    return _unit_counts(dim)(hash_buckets(F.coalesce(text, F.lit("")), dim))
