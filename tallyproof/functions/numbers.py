"""Guarded arithmetic: a result is null unless all that it needs is there."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(x, y, scale: float = 1.0, digits: int = 2) -> Column:
    """round(x * scale / y); null for a zero denominator."""
    return F.round(col(x).cast("double") * scale / F.nullif(col(y).cast("double"), F.lit(0.0)), digits)


def pct(x, y) -> Column:
    """x as a percentage of y."""
    return ratio(x, y, 100.0)


def change_pct(now, before) -> Column:
    """Percentage change from before to now."""
    return pct(col(now).cast("double") - col(before).cast("double"), before)


def difference(right, left) -> Column:
    """Exact difference of two numbers of one type."""
    return col(right) - col(left)


def rounded(x, digits: int) -> Column:
    """round(x) for many rows of doubles that have no more than so many digits but for errors
    of arithmetic: one product and one quotient, where round goes over decimal text. Large
    numbers, whose product isn't exact, are left to round."""
    v, scale = col(x), float(10**digits)
    return F.when(F.abs(v) < 1e15 / scale, F.rint(v * scale) / scale).otherwise(F.round(v, digits))


def direction(right, left) -> Column:
    """-1, 0 or 1; null if either is missing."""
    return F.signum(difference(right, left)).cast("int")


def close(x, y, tolerance: float) -> Column:
    """Equality within a tolerance, where two nulls are equal and one isn't."""
    a, b = col(x), col(y)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(F.abs(a.cast("double") - b.cast("double")) <= tolerance)


def cosine(a, b) -> Column:
    """Cosine of two vectors in double precision; 0 for a zero norm or lengths that
    differ."""
    x, y = col(a), col(b)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) != F.size(y)) | (norm == 0), F.lit(0.0)).otherwise(dot(x, y) / norm)


def guarded_sum(value, rank, expected: int, digits: int = 2) -> Column:
    """Sum over exactly `expected` rows with as many distinct ranks and values."""
    complete = (F.count(F.lit(1)) == expected) & (F.countDistinct(col(rank)) == expected) & (F.count(col(value)) == expected)
    return F.when(complete, F.round(F.sum(col(value).cast("decimal(18,4)")), digits).cast("double"))


def guarded_avg(value, digits: int = 2) -> Column:
    """Average, null unless every row has a value."""
    v = col(value)
    return F.when(F.count(v) == F.count(F.lit(1)), F.round(F.sum(v.cast("decimal(18,4)")).cast("double") / F.count(v), digits))


def unanimous(value) -> Column:
    """The one value that all rows of the group share, else null."""
    v = col(value)
    return F.when((F.count(v) == F.count(F.lit(1))) & (F.countDistinct(v) == 1), F.max(v))
