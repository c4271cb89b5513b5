"""Scalar helpers: numbers in text, epoch units, literals, number format."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text that counts as a number: no suffixes, hexadecimals or underscores.
NUMBER = r"^\s*[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"
# Magnitudes of epoch bounds, seconds a unit.
EPOCH_UNITS = ((6e8, 4.2e9, 1.0), (6e11, 4.2e12, 1e-3), (6e14, 4.2e15, 1e-6), (6e17, 4.2e18, 1e-9))


def kind_of(df: DataFrame, column: str) -> str:
    """numeric, float, bool, time, text or other."""
    t = df.schema[column].dataType
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "float"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "text" if isinstance(t, (T.StringType, T.CharType, T.VarcharType)) else "other"


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def present(df: DataFrame, column: str) -> Column:
    """True unless null; NaN counts as null."""
    c = F.col(quoted(column))
    return c.isNotNull() & ~F.isnan(c) if kind_of(df, column) == "float" else c.isNotNull()


def as_number(df: DataFrame, column: str) -> Column:
    """The value as a double; null where it is none, NaN included."""
    c, kind = F.col(quoted(column)), kind_of(df, column)
    if kind == "float":
        return F.when(~F.isnan(c), c.cast("double"))
    if kind in ("numeric", "bool"):
        return c.cast("double")
    if kind == "text":
        return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))
    return F.lit(None).cast("double")


def epoch_seconds(bound: object) -> float | None:
    """Seconds since 1970 of a numeric bound whose unit its magnitude tells."""
    if isinstance(bound, bool) or not isinstance(bound, (int, float)) or not math.isfinite(bound):
        return None
    for low, high, unit in EPOCH_UNITS:
        if low <= abs(bound) <= high:
            return bound * unit
    return None


def epoch_literal(bound: object) -> datetime | None:
    seconds = epoch_seconds(bound)
    return None if seconds is None else datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)


def sql_literal(value: object) -> str:
    """A literal of Spark SQL, in which backslashes escape."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "''") + "'"


def short_number(value: object) -> str:
    """null, six significant digits for floats, else the text."""
    if value is None:
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def java_pattern(pattern: str) -> str | None:
    """The pattern for Spark, matching whole strings; None if it doesn't compile."""
    try:
        re.compile(pattern)
    except (re.error, RecursionError, OverflowError):
        return None
    named = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", named)
    return rf"\A(?:{named})\z"


def common_prefix_length(a: Column, b: Column) -> Column:
    """Characters that two texts share from the start."""
    size = F.least(F.length(a), F.length(b))
    longer = F.filter(F.sequence(F.lit(0), size), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(longer).cast("long")
