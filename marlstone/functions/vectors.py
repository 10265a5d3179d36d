"""Vector functions on arrays of floats; arithmetic is in double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a tiny addend per norm makes a zero vector score 0."""
    return dot(a, b) / ((norm(a) + 1e-12) * (norm(b) + 1e-12))


def _blobs(vectors: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else np.asarray(v, np.float32).tobytes() for v in vectors], dtype=object)


def _vectors(blobs: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else np.frombuffer(b, np.float32) for b in blobs], dtype=object)


def to_blob(vector: str) -> Column:
    """A vector as the native bytes of its float32 values."""
    return F.pandas_udf(_blobs, "binary")(vector)


def from_blob(blob: str) -> Column:
    return F.pandas_udf(_vectors, "array<float>")(blob)
