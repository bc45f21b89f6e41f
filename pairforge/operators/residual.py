"""Residual similarity: cosine after the class-mean direction is removed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.vectors import GUARD, as_lists, as_matrix, row_dots

VANISHING = 1e-6


@dataclass(frozen=True)
class Projection:
    """Global centre and unit class direction: two vectors of the embedding width."""

    center: tuple[float, ...]
    direction: tuple[float, ...]


def vector_sums(df: DataFrame, vec: str = "vec", label: str = "label") -> DataFrame:
    """Per-label vector sums: one partial row per task and label, then a small sum."""

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[int, tuple[int, object]] = {}
        for batch in batches:
            rows, labels = as_matrix(batch.column(0)), batch.column(1).to_numpy()
            for value in np.unique(labels):
                part = rows[labels == value]
                count, total = sums.get(int(value), (0, 0.0))
                sums[int(value)] = (count + len(part), total + part.sum(axis=0))
        if sums:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(sums), pa.int64()),
                    pa.array([n for n, _ in sums.values()], pa.int64()),
                    as_lists(np.vstack([t for _, t in sums.values()])),
                ],
                names=["label", "n", "total"],
            )

    partials = df.select(F.col(vec).cast("array<double>"), F.col(label).cast("bigint")).mapInArrow(
        partial, "label bigint, n bigint, total array<double>"
    )
    return (
        partials.select("label", "n", F.posexplode("total").alias("pos", "x"))
        .groupBy("label", "pos")
        .agg(F.sum("n").alias("n"), F.sum("x").alias("total"))
    )


def projection_table(df: DataFrame, vec: str = "vec", label: str = "label") -> DataFrame:
    """One row per dimension: centre and raw class-mean difference."""
    positive = F.col("label") == 1
    return vector_sums(df, vec, label).groupBy("pos").agg(
        (F.sum("total") / F.sum("n")).alias("center"),
        (
            F.sum(F.when(positive, F.col("total"))) / F.sum(F.when(positive, F.col("n")))
            - F.sum(F.when(~positive, F.col("total"))) / F.sum(F.when(~positive, F.col("n")))
        ).alias("difference"),
    )


def fit_projection(df: DataFrame, vec: str = "vec", label: str = "label") -> Projection:
    """Fit on source vectors. Only one row per embedding dimension reaches the driver."""
    rows = projection_table(df, vec, label).orderBy("pos").collect()
    if not rows or rows[0]["difference"] is None:
        raise ValueError("both labels need at least one vector")
    norm = sum(r["difference"] ** 2 for r in rows) ** 0.5
    if norm <= GUARD:
        raise ValueError("the class means do not define a direction")
    return Projection(
        tuple(r["center"] for r in rows), tuple(r["difference"] / norm for r in rows)
    )


def _kernel(projection: Projection):
    import numpy as np

    center = np.asarray(projection.center)
    direction = np.asarray(projection.direction)

    def remove(rows):
        shifted = rows - center
        return shifted - row_dots(shifted, direction[None, :])[:, None] * direction

    return remove


def residualize(projection: Projection, vec: Column) -> Column:
    remove = _kernel(projection)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def kernel(vectors):
        return as_lists(remove(as_matrix(vectors)))

    return kernel(vec)


def residual_cosine(projection: Projection, source: Column, candidate: Column) -> Column:
    """Cosine of two residuals; 1.0 when either residual vanishes."""
    remove = _kernel(projection)

    @F.arrow_udf(T.DoubleType())
    def kernel(left, right):
        import numpy as np
        import pyarrow as pa

        a, b = remove(as_matrix(left)), remove(as_matrix(right))
        na, nb = np.sqrt(row_dots(a, a)), np.sqrt(row_dots(b, b))
        value = row_dots(a, b) / (na * nb + GUARD)
        return pa.array(np.where((na < VANISHING) | (nb < VANISHING), 1.0, value))

    return kernel(source, candidate)
