"""Rounding and rate helpers shared by every report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rnd(value: Column, digits: int = 3) -> Column:
    """Round half away from zero in double arithmetic.

    Spark's ``round`` goes through a decimal and differs from binary rounding on
    a few ratios, so all reports round with this one helper.
    """
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double; NULL where the denominator is zero or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def rate(condition: Column, digits: int = 3) -> Column:
    """Share of a group's rows that meet a condition."""
    return rnd(ratio(F.count_if(condition), F.count(F.lit(1))), digits)


def mean(value: Column, digits: int = 3) -> Column:
    return rnd(F.avg(value), digits)


def rows() -> Column:
    return F.count(F.lit(1))


def json_safe(df: DataFrame) -> DataFrame:
    """Replace NaN and infinities of every floating column by NULL."""
    projection = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
            c = F.when(finite, c).alias(field.name)
        projection.append(c)
    return df.select(*projection)
