"""Vector arithmetic on Arrow batches.

Array lambdas are interpreted element by element; for vectors of tens to thousands of values a vectorised function over the flat
Arrow buffers is much faster. Rows stay distributed as they are: a batch is a slice of one partition.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def rows_of(column: pa.Array) -> np.ndarray:
    """Fixed-length list column without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lengths_of(column: pa.Array) -> np.ndarray:
    """Number of values of each list."""
    return np.diff(column.offsets.to_numpy())


@F.arrow_udf(DoubleType())
def euclidean(a: pa.Array, b: pa.Array) -> pa.Array:
    """Euclidean distance of two vector columns (same length in a row, no nulls)."""
    out, sizes = np.zeros(len(a)), lengths_of(a)
    for size in np.unique(sizes):   # groups of a table may have vectors of different lengths
        at = np.flatnonzero(sizes == size)
        some = pa.array(at)
        x, y = (a, b) if len(at) == len(a) else (a.take(some), b.take(some))
        out[at] = np.sqrt(np.square(rows_of(x) - rows_of(y)).sum(axis=1)) if size else 0.0
    return pa.array(out, type=pa.float64())
