"""Typed canonical values of text cells: a value or an error, never a silent cast."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import col
from .text import blank_to_null

PATTERNS = {"count": r"^[0-9]+$", "rank": r"^[0-9]+$", "decimal": r"^[+-]?[0-9]+(\.[0-9]+)?$", "date": r"^\d{4}-\d{2}-\d{2}$", "month": r"^\d{4}-(0[1-9]|1[0-2])$", "text": r"(?s)^.*$"}
TYPES = {"count": "bigint", "rank": "int", "decimal": "decimal(38,10)", "date": "date", "month": "string", "text": "string"}


def canonical(c, kind: str) -> Column:
    """The value of a cell of that kind; null for a blank or an invalid one."""
    t = blank_to_null(c)
    v = F.when(t.rlike(PATTERNS[kind]), t.try_cast(TYPES[kind]))
    return F.when(v >= 1, v) if kind == "rank" else v


def error(c, kind: str, name: str) -> Column:
    """A message if the cell is neither blank nor valid, else null."""
    return F.when(blank_to_null(c).isNotNull() & canonical(c, kind).isNull(), F.lit(f"{name}: not a {kind}"))


def finite(c) -> Column:
    """A number's text as a double if it is finite and not zero by underflow."""
    v = col(c).try_cast("double")
    zero = ~F.regexp_extract(col(c), r"^[^eE]*", 0).rlike("[1-9]")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")) & ((v != 0) | zero), v)


def errors(*messages: Column) -> Column:
    """The messages that aren't null, as an array."""
    return F.filter(F.array(*messages), lambda x: x.isNotNull())


def sql_function(spark, name: str, kind: str) -> None:
    """Registers the canonical value as a SQL function of one text argument."""
    strip = "regexp_replace(v, '^[\\\\s\\\\p{Z}]+|[\\\\s\\\\p{Z}]+$', '')"
    pattern = PATTERNS[kind].replace("\\", "\\\\")
    guard = f"CASE WHEN {strip} RLIKE '{pattern}' THEN try_cast({strip} AS {TYPES[kind]}) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING) RETURNS {TYPES[kind]} RETURN {guard}")
