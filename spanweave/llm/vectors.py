"""Vectors in array columns: which of them count, and how they reach NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_sound(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    infinite = F.lit(float("inf"))
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < infinite))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def by_dimension(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and float64 matrix of the vectors of each dimension in a list column without nulls."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        part = column if len(at) == len(lengths) else column.take(pa.array(at))
        out[int(d)] = (at, part.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(at), int(d)))
    return out
