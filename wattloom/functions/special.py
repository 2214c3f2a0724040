"""Scalar functions that Spark SQL lacks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0, by a rational approximation with error below 1e-7
    (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + F.lit(0.2316419) * z)
    # Coefficients of the approximation.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = F.lit(0.0)
    for c in reversed(b):
        poly = (poly + c) * t
    return F.exp(-z * z / 2) / F.lit(2.5066282746310002) * poly


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation of the pairs without a null; null where a side does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts alone, the same in any engine with md5:
    the first 32 bits of the digest of the parts joined by `|`."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
