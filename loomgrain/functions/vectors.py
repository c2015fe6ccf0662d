"""Vector expressions over ARRAY<FLOAT>, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits to which distances are rounded before they are compared, so that the order of summing can't change a rank.
DIGITS = 6


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b), size), F.lit(0.0))


def quantised(a: Column) -> Column:
    """(scale, codes): the vector in whole steps of scale between -127 and 127."""
    top = F.coalesce(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(0.0))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(a, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("codes"))
