"""Expressions over arrays of label scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(v) -> Column:
    return F.col(v) if isinstance(v, str) else v


def _let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once, not once per use."""
    return F.transform(F.array(value), body).getItem(0)


def softmax(v) -> Column:
    v = _col(v)
    grown = _let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))

    def shares(g):
        total = F.aggregate(g, F.lit(0.0), lambda acc, x: acc + x)
        return _let(total, lambda t: F.transform(g, lambda x: x / t))

    return _let(grown, shares)


def top_share(v) -> Column:
    """The softmax value of the maximum."""
    v = _col(v)
    return _let(
        F.array_max(v),
        lambda top: F.lit(1.0) / F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)),
    )


def argmax(v) -> Column:
    """0-based position of the first maximum."""
    v = _col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("bigint")


def id_to_label(i, labels: dict[int, str]) -> Column:
    pairs = [F.lit(x) for k, name in labels.items() for x in (int(k), name)]
    return F.try_element_at(F.create_map(*pairs), _col(i).cast("int"))
