"""pass@k column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def pass_at_k(n, c, k) -> Column:
    """Unbiased estimator ``1 - prod_{i=n-c+1..n} (1 - k/i)``; 1.0 when n - c < k.

    ``c = 0`` is guarded: ``sequence(n+1, n)`` would run downwards in Spark.
    """
    n, c, k = _c(n).cast("long"), _c(c).cast("long"), _c(k).cast("long")
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - k.cast("double") / i.cast("double")))
    return (F.when(n - c < k, F.lit(1.0))
            .when(c == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - prod))


def binomial(m, r) -> Column:
    """C(m, r) as a double, 0 when r > m or r < 0 (product of r ratios)."""
    m, r = _c(m).cast("long"), _c(r).cast("long")
    prod = F.aggregate(F.sequence(F.lit(1).cast("long"), r), F.lit(1.0),
                       lambda acc, i: acc * (m - r + i).cast("double") / i.cast("double"))
    return (F.when((r < 0) | (r > m), F.lit(0.0))
            .when(r == 0, F.lit(1.0))
            .otherwise(prod))


def pass_at_k_comb(pass_k, n_samples, n_success) -> Column:
    """``1 - C(samples - successes, k) / C(samples, k)``.

    Same value as :func:`pass_at_k` for 0 <= successes <= samples (checked in
    the tests); 1.0 when fewer than k failures remain.
    """
    k, m, s = _c(pass_k).cast("long"), _c(n_samples).cast("long"), _c(n_success).cast("long")
    return (F.when(m - s < k, F.lit(1.0))
            .otherwise(F.lit(1.0) - F.try_divide(binomial(m - s, k), binomial(m, k))))
