"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL on a zero denominator, also under ANSI mode."""
    return numerator / F.nullif(denominator, F.lit(0).cast("double"))


def number_or(value: Column, default: float = 0.0) -> Column:
    """Text to DOUBLE, with a default for anything unreadable."""
    return F.coalesce(value.try_cast("double"), F.lit(default))


def is_close(left: Column, right: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)


def mean_sd_cell(mean: Column, sd: Column, scale: float = 100.0, digits: int = 1) -> Column:
    sd = F.coalesce(sd, F.lit(float("nan")))
    return F.when(mean.isNull(), "--").otherwise(
        F.concat(fixed(mean * scale, digits), F.lit(" ± "), fixed(sd * scale, digits))
    )


def range_cell(low: Column, high: Column, scale: float = 100.0, digits: int = 1) -> Column:
    return F.when(low.isNull() | high.isNull(), "--").otherwise(
        F.concat(fixed(low * scale, digits), F.lit("–"), fixed(high * scale, digits))
    )


def interval_cell(
    value: Column, low: Column, high: Column, scale: float = 100.0, digits: int = 1
) -> Column:
    shown = [F.coalesce(fixed(c * scale, digits), F.lit("null")) for c in (value, low, high)]
    return F.when(value.isNull(), "--").otherwise(
        F.concat(shown[0], F.lit(" ["), shown[1], F.lit(", "), shown[2], F.lit("]"))
    )


def fixed(value: Column, digits: int) -> Column:
    """``%.<digits>f`` of the number as it is stored, ties to even.

    Java's formatter rounds the shortest decimal text of a number instead, and its ties up.
    """

    @F.arrow_udf(T.StringType())
    def shown(numbers):
        import pyarrow as pa

        texts = (None if v is None else "NaN" if v != v else f"{v:.{digits}f}" for v in numbers.to_pylist())
        return pa.array(list(texts), pa.string())

    return shown(value.cast("double"))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function from a Python helper on batches."""
    return _normal_cdf(z)


def student_two_sided(t: Column, dof: Column) -> Column:
    """Two-sided tail probability of Student's t."""
    return _student_tail(t, dof)


@F.arrow_udf(T.DoubleType())
def _normal_cdf(z):
    from math import erfc, sqrt

    import pyarrow as pa

    return pa.array(
        [None if v is None else 0.5 * erfc(-v / sqrt(2.0)) for v in z.to_pylist()], pa.float64()
    )


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return total
    raise ArithmeticError("the incomplete beta function did not converge")


NEAR_NORMAL = 10_000.0  # degrees of freedom above which a normal expansion is exact enough


def student_tail(t: float | None, dof: float | None) -> float | None:
    from math import erfc, exp, isinf, lgamma, log, log1p, sqrt

    if t is None or dof is None or dof <= 0:
        return None
    if isinf(t):
        return 0.0
    if t == 0.0:
        return 1.0
    if dof > NEAR_NORMAL:
        a = dof - 0.5
        z = sqrt(a * log1p(t * t / dof))
        return erfc((z + (z**3 + 3.0 * z) / (48.0 * a * a)) / sqrt(2.0))
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    scale = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return scale * _beta_fraction(a, b, x) / a
    return 1.0 - scale * _beta_fraction(b, a, 1.0 - x) / b


@F.arrow_udf(T.DoubleType())
def _student_tail(t, dof):
    import pyarrow as pa

    return pa.array(
        [student_tail(a, b) for a, b in zip(t.to_pylist(), dof.to_pylist())], pa.float64()
    )
