"""Vector kernels on Arrow batches. Vectors are equal-length ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GUARD = 1e-12


def as_matrix(array):
    """Rows of a list array as a float64 matrix, without copying where possible."""
    import numpy as np

    if array.null_count:
        raise ValueError("vector column holds NULL")
    if hasattr(array, "combine_chunks"):
        array = array.combine_chunks()
    flat = np.asarray(array.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 0)


def as_lists(matrix):
    """A matrix as an Arrow list array."""
    import numpy as np
    import pyarrow as pa

    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def row_dots(left, right):
    """Dot products of paired rows, added from the first component to the last.

    A matrix product adds in an order that depends on the row's place in the batch, so equal
    pairs could get different last bits and equal values would no longer be ties.
    """
    import numpy as np

    total = np.zeros(len(left))
    for x, y in zip(left.T, right.T):
        total += x * y
    return total


@F.arrow_udf(T.DoubleType())
def dot(left, right):
    import pyarrow as pa

    return pa.array(row_dots(as_matrix(left), as_matrix(right)))


@F.arrow_udf(T.DoubleType())
def cosine(left, right):
    """Plain cosine with a guarded denominator."""
    import numpy as np
    import pyarrow as pa

    a, b = as_matrix(left), as_matrix(right)
    norms = np.sqrt(row_dots(a, a)) * np.sqrt(row_dots(b, b))
    return pa.array(row_dots(a, b) / (norms + GUARD))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unit(vector):
    """L2-normalised vector; a zero vector stays zero."""
    import numpy as np

    rows = as_matrix(vector)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return as_lists(rows / np.where(norms > 0.0, norms, 1.0)[:, None])


def dots_with(matrix: list[list[float]]):
    """Column function: dot products of a vector with each row of a small matrix."""
    import numpy as np

    fixed = np.asarray(matrix, dtype=np.float64)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def products(vector):
        return as_lists(as_matrix(vector) @ fixed.T)

    def apply(vector: Column) -> Column:
        return products(vector)

    return apply
