"""Failure codes of rules, as columns over joined schema facts and registries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import CODES, canonical
from ..session import local_rows
from .parsing import rule_of

# Thresholds of the empirical codes.
OVER_TIGHT, VACUOUS = 0.50, 1.0


def _number(v: object) -> float | None:
    return float(v) if isinstance(v, (int, float)) else None


def _misreads(rule, sentinels: list) -> bool:
    if rule.predicate == "not_null":
        return None in sentinels
    present = [s for s in sentinels if s is not None]
    if rule.predicate == "in_set":
        return any(s not in (rule.params.get("allowed") or []) for s in present)
    if rule.predicate == "range":
        low, high = _number(rule.params.get("min")), _number(rule.params.get("max"))
        numbers = [float(s) for s in present if isinstance(s, (int, float)) and not isinstance(s, bool)]
        return any((low is not None and s < low) or (high is not None and s > high) for s in numbers)
    if rule.predicate == "regex":
        try:
            pattern = re.compile(str(rule.params.get("pattern", "")))
        except re.error:
            return False
        return any(not pattern.fullmatch(s) for s in present if isinstance(s, str))
    return False


def _plain(v: object) -> object:
    return int(v) if isinstance(v, float) and v.is_integer() else v


def code_rules(rules: list[dict], schema: dict[str, dict], sentinels: dict[str, list], protected: set[str], spark, vacuous: bool = False, levels_limit: int | None = 20) -> DataFrame:
    """``set_id, pos, rule_id, column, codes`` of parsed rules.

    ``rules`` are rows of ``explode_rules`` with ``set_id`` and ``retention`` (None
    if not run); ``schema`` maps columns to {kind, levels, min, max}.  There are as
    many rows as rules, so facts are attached here and codes assigned in columns.
    """
    rows = []
    for r in rules:
        rule = rule_of(r)
        fact = schema.get(r["column"] or "")
        levels = (fact or {}).get("levels")
        if levels is not None and levels_limit is not None:
            levels = levels[:levels_limit]
        invented = bool(rule.predicate == "in_set" and levels and {_plain(v) for v in rule.params.get("allowed") or [] if not isinstance(v, (list, dict))} - {_plain(v) for v in levels})
        rows.append((
            r["set_id"], r["pos"], r["rule_id"], r["column"], r["predicate"], r["severity"], r["executable"], r.get("retention"),
            canonical(rule), fact is not None, fact["kind"] if fact else None,
            rule.predicate == "cross_column" and rule.params.get("other_column") not in schema,
            _number(rule.params.get("min")), _number(rule.params.get("max")),
            _number((fact or {}).get("min")), _number((fact or {}).get("max")),
            invented, bool(r["column"] in sentinels and _misreads(rule, sentinels[r["column"]])), r["column"] in protected,
        ))
    fields = (
        "set_id string, pos int, rule_id string, column string, predicate string, severity string, executable boolean, retention double, canonical string, known boolean, kind string, "
        "other_missing boolean, low double, high double, seen_min double, seen_max double, invented boolean, misread boolean, protected boolean"
    )
    return assign_codes(local_rows(spark, rows, fields), vacuous)


def assign_codes(facts: DataFrame, vacuous: bool = False) -> DataFrame:
    """Codes in taxonomy order from the joined facts of each rule."""
    c = F.col
    numeric = c("kind").isin("int", "float")
    known, runs = c("known"), c("executable")
    repeated = F.row_number().over(Window.partitionBy("set_id", "canonical").orderBy("pos")) > 1
    empirical = known & runs
    tests: dict[str, Column] = {
        "F1": ~known | c("other_missing"),
        "F2": empirical & c("invented"),
        "F3": empirical & (c("predicate") == "range") & numeric
        & F.when(c("low") > c("seen_max"), True).otherwise(F.coalesce(c("high") < c("seen_min"), F.lit(False))),
        "F4": empirical & (c("retention") < OVER_TIGHT),
        "F5": (empirical & (c("retention") >= VACUOUS)) if vacuous else F.lit(False),
        "F6": known & (((c("predicate") == "range") & ~numeric) | ((c("predicate") == "regex") & numeric)),
        "F7": ~runs,
        "F8": repeated,
        "F9": empirical & c("misread"),
        "F10": empirical & c("protected") & (c("retention") < VACUOUS) & c("severity").isin("reject", "quarantine"),
    }
    codes = F.array_compact(F.array(*[F.when(F.coalesce(tests[k], F.lit(False)), F.lit(k)) for k in CODES]))
    return facts.select("set_id", "pos", "rule_id", "column", codes.alias("codes"))


def code_histogram(coded: DataFrame) -> DataFrame:
    """Rules with each code and their share; all ten codes have a row."""
    spark = coded.sparkSession
    all_codes = local_rows(spark, [(k, i) for i, k in enumerate(CODES)], "code string, place int")
    counts = coded.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    total = coded.agg(F.count(F.lit(1)).alias("rules"))
    return all_codes.join(counts, "code", "left").join(F.broadcast(total)).select(
        "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (100 * F.coalesce("n", F.lit(0)) / F.nullif("rules", F.lit(0))).alias("percent")
    )


def codes_per_set(coded: DataFrame) -> DataFrame:
    return coded.groupBy("set_id").agg(F.count(F.lit(1)).alias("n_rules"), *[F.count_if(F.array_contains("codes", k)).alias(k) for k in CODES])


def executable(coded: DataFrame) -> DataFrame:
    return coded.filter(~F.array_contains("codes", "F7"))

