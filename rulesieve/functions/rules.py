"""The rule model and its compile targets."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import as_number, epoch_literal, java_pattern, kind_of, present, quoted, sql_literal

# Fixed values of the rule language.
DIMENSIONS = ("completeness", "validity", "consistency", "accuracy", "uniqueness", "timeliness")
PREDICATES = ("not_null", "in_set", "range", "regex", "unique", "cross_column", "type")
SEVERITIES = ("reject", "quarantine", "warn")
CODES = ("F1", "F2", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "F10")
NUMERIC_EXPECTED = ("int", "float", "numeric")


@dataclass(frozen=True)
class Rule:
    column: str
    predicate: str
    params: dict = field(default_factory=dict)
    rule_id: str = ""
    severity: str = "reject"
    dimension: str = "validity"


class NotExecutable(Exception):
    """The rule can't be evaluated on this table and is skipped, not failed."""


def _never_null(c: Column, default: bool = False) -> Column:
    return F.coalesce(c, F.lit(default))


def _in_set(df: DataFrame, rule: Rule) -> Column:
    allowed = list(rule.params.get("allowed") or [])
    c, kind = F.col(quoted(rule.column)), kind_of(df, rule.column)
    numbers = [float(v) for v in allowed if isinstance(v, (int, float)) and not isinstance(v, bool)]
    if kind == "bool":
        wanted = {bool(v) for v in allowed if isinstance(v, bool) or v in (0, 1)}
        return _never_null(c.isin(list(wanted))) if wanted else F.lit(False)
    hits = []
    if kind == "text" and (texts := [v for v in allowed if isinstance(v, str)]):
        hits.append(_never_null(c.isin(texts)))
    if numbers:
        hits.append(_never_null(as_number(df, rule.column).isin(numbers)))
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def _range(df: DataFrame, rule: Rule) -> Column:
    low, high = rule.params.get("min"), rule.params.get("max")
    if kind_of(df, rule.column) == "time":
        value = F.col(quoted(rule.column)).cast("timestamp_ltz")
        bounds = [(b, epoch_literal(b)) for b in (low, high)]
        if any(b is not None and at is None for b, at in bounds):
            return F.lit(False)
        low, high = (at and F.lit(at) for _, at in bounds)
    else:
        value = as_number(df, rule.column)
        for b in (low, high):
            if b is not None and not isinstance(b, (int, float)):
                raise NotExecutable(f"bound {b!r} is no number")
    tests = []
    if low is not None:
        tests.append(value >= low)
    if high is not None:
        tests.append(value <= high)
    return _never_null(reduce(and_, tests)) if tests else F.lit(True)


def _cross(df: DataFrame, rule: Rule) -> Column:
    op, other = rule.params.get("op"), rule.params.get("other_column")
    if op not in ("<", "<=", ">", ">=", "==", "!=") or other not in df.columns:
        return F.lit(True)
    kinds = [kind_of(df, x) for x in (rule.column, other)]
    numeric = [k in ("numeric", "float", "bool") for k in kinds]
    if all(numeric):
        a, b = as_number(df, rule.column), as_number(df, other)
    elif kinds[0] == kinds[1]:
        a, b = F.col(quoted(rule.column)), F.col(quoted(other))
    elif op in ("==", "!="):
        return F.lit(op == "!=")
    else:
        raise NotExecutable(f"{kinds[0]} and {kinds[1]} have no order")
    test = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op]
    return _never_null(test, op == "!=")


def mask(df: DataFrame, rule: Rule) -> Column:
    """True where a row passes; never null.

    ``unique`` reads the column that ``with_unique_counts`` adds.  A rule on an
    absent column passes everything.
    """
    if rule.column not in df.columns:
        return F.lit(True)
    if rule.predicate == "not_null":
        return present(df, rule.column)
    if rule.predicate == "in_set":
        return _in_set(df, rule)
    if rule.predicate == "range":
        return _range(df, rule)
    if rule.predicate == "regex":
        pattern = java_pattern(str(rule.params.get("pattern", "")))
        if pattern is None:
            raise NotExecutable("the pattern doesn't compile")
        return F.coalesce(F.col(quoted(rule.column)).cast("string"), F.lit("nan")).rlike(pattern)
    if rule.predicate == "unique":
        return _never_null(F.col(unique_name(rule.column)))
    if rule.predicate == "cross_column":
        return _cross(df, rule)
    if rule.predicate == "type" and rule.params.get("expected") in NUMERIC_EXPECTED:
        return as_number(df, rule.column).isNotNull()
    return F.lit(True)


def unique_name(column: str) -> str:
    return f"__one_row_has_{column}"


def with_unique_counts(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add, for each column with a ``unique`` rule, whether a row is the only one with its value.

    Rows are combined by value before the shuffle, and only values that one row
    has come back to the table, so rows of a modal value find no partner; nulls
    (and NaN) are one group.
    """
    for column in sorted({r.column for r in rules if r.predicate == "unique" and r.column in df.columns}):
        value = F.when(present(df, column), F.col(quoted(column)))
        single = df.groupBy(value.alias("__value")).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows = 1").select("__value", F.lit(True).alias(unique_name(column)))
        df = df.withColumn("__key", value).join(single, F.col("__key").eqNullSafe(F.col("__value")), "left").drop("__key", "__value")
    return df


def unique_mask_window(df: DataFrame, column: str) -> Column:
    """The window form of ``unique``, for tables without hot values."""
    return F.count(F.lit(1)).over(Window.partitionBy(F.when(present(df, column), F.col(quoted(column))))) == 1


def sql_check(rule: Rule) -> str:
    """The rule as SQL text with SQL's own nulls (a CHECK constraint)."""
    c, p = quoted(rule.column), rule.params
    if rule.predicate == "not_null":
        return f"{c} IS NOT NULL"
    if rule.predicate == "in_set":
        return f"{c} IN ({', '.join(map(sql_literal, p.get('allowed', [])))})"
    if rule.predicate == "range":
        bounds = [f"{c} {sign} {sql_literal(p[key])}" for key, sign in (("min", ">="), ("max", "<=")) if p.get(key) is not None]
        return " AND ".join(bounds) or "TRUE"
    if rule.predicate == "regex":
        return f"{c} RLIKE {sql_literal(p.get('pattern', '.*'))}"
    if rule.predicate == "cross_column":
        return f"{c} {p.get('op')} {quoted(str(p.get('other_column')))}"
    if rule.predicate == "type" and p.get("expected") in NUMERIC_EXPECTED:
        return f"CAST({c} AS DOUBLE) IS NOT NULL"
    return "TRUE"


#: Names of the expectation suite's checks, by predicate; fixed values.
EXPECTATIONS = {
    "not_null": "expect_column_values_to_not_be_null",
    "in_set": "expect_column_values_to_be_in_set",
    "range": "expect_column_values_to_be_between",
    "regex": "expect_column_values_to_match_regex",
    "unique": "expect_column_values_to_be_unique",
    "cross_column": "expect_column_pair_values_a_to_be_greater_than_b",
    "type": "expect_column_values_to_not_be_null",
}


def expectation(rule: Rule) -> dict:
    """The rule as an expectation-suite entry."""
    p = rule.params
    more = {
        "in_set": {"value_set": p.get("allowed", [])},
        "range": {"min_value": p.get("min"), "max_value": p.get("max")},
        "regex": {"regex": p.get("pattern", ".*")},
    }.get(rule.predicate, {})
    arguments = {"column_A": rule.column, "column_B": p.get("other_column")} if rule.predicate == "cross_column" else {"column": rule.column, **more}
    return {"expectation_type": EXPECTATIONS[rule.predicate], "kwargs": arguments, "meta": {"rule_id": rule.rule_id, "dimension": rule.dimension}}


def _scalar(v: object) -> str:
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, (int, float)):
        return f"n:{int(v) if float(v).is_integer() else v}"
    return f"s:{v}" if isinstance(v, str) else f"j:{json.dumps(v, sort_keys=True)}"


def canonical(rule: Rule) -> str:
    """Equal for rules that test the same thing; ids, severity and wording don't count."""
    parts = {}
    for key, value in rule.params.items():
        parts[key] = sorted(map(_scalar, value)) if key == "allowed" and isinstance(value, list) else _scalar(value)
    return json.dumps([rule.column, rule.predicate, parts], sort_keys=True)
