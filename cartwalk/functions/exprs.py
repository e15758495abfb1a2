"""Small JVM-side expression builders (all stay inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x) -> Column:
    """Round half-up to 6 decimals the same way in Spark and DuckDB.

    ``round`` differs between engines on doubles at the .5 boundary, so
    results that are compared across engines use this floor form.
    """
    return F.floor(_c(x) * F.lit(1e6) + F.lit(0.500001)) / F.lit(1e6)


def rank_key(x) -> Column:
    """Score key for ranking: 12-decimal rounding so float noise cannot
    reorder ties; callers always add an id as the second key.  The key stays
    a double (``floor`` would make it a long, which large scores overflow)."""
    y = _c(x) * F.lit(1e12) + F.lit(0.5)
    return y - F.pmod(y, F.lit(1.0))


def safe_div(num, den) -> Column:
    """``num / den`` with null for a zero denominator (SQL ``nullif``)."""
    den = _c(den)
    return _c(num) / F.when(den != 0, den)


def as_long(x) -> Column:
    return _c(x).cast("long")


def l1_share(x, total) -> Column:
    return _c(x) / _c(total)


def log2(x) -> Column:
    return F.log2(_c(x))
