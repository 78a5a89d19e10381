"""Arithmetic on ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COSINE_EPS = 1e-8


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a, b) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def squared_l2(a, b) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def cosine(a, b, eps: float = COSINE_EPS) -> Column:
    return dot(a, b) / F.greatest(l2_norm(a) * l2_norm(b), F.lit(eps))


def rounded(v, digits: int = 6) -> Column:
    return F.transform(_col(v), lambda x: F.round(x, digits) + F.lit(0.0))
