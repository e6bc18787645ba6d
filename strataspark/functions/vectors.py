"""Dense vectors held as array<double> columns (JVM higher-order functions)."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from .draws import _col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalise(a, eps: float = 1e-8) -> Column:
    n = norm(a) + F.lit(eps)
    return F.transform(_col(a), lambda x: x.cast("double") / n)


def minus(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") - y.cast("double"))


def max_abs_diff(a, b, unit) -> Column:
    """max_f |a_f - b_f| / unit_f"""
    d = F.zip_with(minus(a, b), _col(unit), lambda x, u: F.abs(x) / u)
    return F.array_max(d)
