"""Vectors of integers, as clustering and mining compare them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components stay below this, so that sums of 64 products or squared differences fit in 64 bits.
SPAN = 1 << 27


def integers(vector: Column, scale: int) -> Column:
    """floor(scale x) of every component, as int; null if the vector or a component is null or not finite, or a component reaches SPAN."""
    scaled = lambda x: x.cast("double") * scale
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(scaled(x)) >= float(SPAN)))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)), F.transform(vector, lambda x: F.floor(scaled(x)).cast("int")))


def matrix(column: pa.ChunkedArray | pa.Array, width: int):
    """The vectors of a column, one a line, as 64-bit integers."""
    import numpy as np

    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, width).astype(np.int64)
