import json
import math

import pytest
from pyspark.sql import functions as F

from rulesieve.functions.rules import NotExecutable, Rule, canonical, expectation, mask, sql_check, unique_mask_window, with_unique_counts
from rulesieve.functions.scalars import epoch_seconds, java_pattern, short_number, sql_literal
from rulesieve.operators.parsing import balanced_object, explode_rules, parse_rulesets

NAN = math.nan
FLOATS = [1.0, -1.0, None, NAN]
TEXTS = ["abc", " 12 ", "1d", "", "5", None, "a\n", "0x10", "1e3", "inf"]


def passes(spark, values, kind, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    wide = with_unique_counts(df, [rule])
    return [r[0] for r in wide.orderBy("i").select(mask(wide, rule)).collect()]


@pytest.mark.parametrize(
    ("predicate", "params", "floats", "texts"),
    [
        ("not_null", {}, "PPFF", "PPPPPFPPPP"),
        ("in_set", {"allowed": [1, "abc", 12]}, "PFFF", "PPFFFFFFFF"),
        ("in_set", {"allowed": [None]}, "FFFF", "FFFFFFFFFF"),
        ("range", {"min": 0, "max": 20}, "PFFF", "FPFFPFFFFF"),
        ("range", {"min": None, "max": None}, "PPPP", "PPPPPPPPPP"),
        ("type", {"expected": "int"}, "PPFF", "FPFFPFFFPP"),
        ("type", {"expected": "string"}, "PPPP", "PPPPPPPPPP"),
        ("cross_column", {"op": "??", "other_column": "c"}, "PPPP", "PPPPPPPPPP"),
        ("cross_column", {"op": "!=", "other_column": "c"}, "FFPP", "FFFFFPFFFF"),
        ("cross_column", {"op": "==", "other_column": "c"}, "PPFF", "PPPPPFPPPP"),
    ],
)
def test_truth_matrix(spark, predicate, params, floats, texts):
    rule = Rule("c", predicate, params)
    for values, kind, expected in ((FLOATS, "double", floats), (TEXTS, "string", texts)):
        assert "".join("FP"[x] for x in passes(spark, values, kind, rule)) == expected


def test_regex_matches_whole_text(spark):
    assert passes(spark, ["a", "ab", "a\n", None], "string", Rule("c", "regex", {"pattern": "a"})) == [True, False, False, False]
    assert passes(spark, [None], "string", Rule("c", "regex", {"pattern": ".*"})) == [True]


def test_unique_treats_nulls_and_nan_as_one_group(spark):
    assert passes(spark, [1.0, 1.0, 2.0, None, NAN], "double", Rule("c", "unique")) == [False, False, True, False, False]
    df = spark.createDataFrame([(1,), (1,), (2,)], "c int")
    assert sorted(r[0] for r in df.select(unique_mask_window(df, "c")).collect()) == [False, False, True]


def test_bool_column(spark):
    assert passes(spark, [True, False, None], "boolean", Rule("c", "in_set", {"allowed": [1]})) == [True, False, False]


def test_epoch_units():
    assert epoch_seconds(1_000_000_000) == epoch_seconds(1_000_000_000_000) == 1e9
    assert epoch_seconds(5) is None and epoch_seconds(True) is None and epoch_seconds("1") is None


def test_not_executable(spark):
    df = spark.createDataFrame([("a", 1.0)], "t string, n double")
    for rule in (Rule("t", "regex", {"pattern": "[[a"}), Rule("t", "cross_column", {"op": "<", "other_column": "n"})):
        if rule.predicate == "regex" and java_pattern("[[a") is not None:
            continue
        with pytest.raises(NotExecutable):
            mask(df, rule)
    assert df.select(mask(df, Rule("absent", "not_null"))).first()[0] is True


def test_texts():
    assert sql_literal("it's") == "'it''s'" and sql_literal(True) == "TRUE" and sql_literal(None) == "NULL"
    assert sql_check(Rule("a`b", "not_null")) == "`a``b` IS NOT NULL"
    assert short_number(1234567.0) == "1.23457e+06" and short_number(None) == "null" and short_number(3) == "3"
    assert expectation(Rule("a", "cross_column", {"other_column": "b"}, "r"))["kwargs"] == {"column_A": "a", "column_B": "b"}


def test_canonical_form():
    same = [Rule("c", "in_set", {"allowed": [1, "1", 2]}, "x", "warn"), Rule("c", "in_set", {"allowed": [2.0, 1.0, "1"]}, "y")]
    assert len({canonical(r) for r in same}) == 1
    assert canonical(Rule("c", "range", {"min": 1})) == canonical(Rule("c", "range", {"min": 1.0})) != canonical(Rule("c", "range", {"min": True}))


def test_balanced_object():
    assert balanced_object('x {"a": "}", "b": {"c": "\\"}"}} y') == '{"a": "}", "b": {"c": "\\"}"}}'
    assert balanced_object("{ unclosed") is None and balanced_object("none") is None and balanced_object(None) is None


@pytest.mark.parametrize(
    ("predicate", "params", "ok"),
    [("range", {}, False), ("range", {"min": None}, False), ("range", {"min": 1, "max": "2"}, False), ("range", {"max": 2}, True), ("range", {"min": True}, True), ("in_set", {"allowed": []}, False),
     ("regex", {"pattern": "(a"}, False), ("cross_column", {"op": "<"}, False), ("type", {"expected": 3}, False), ("unique", {}, True)],
)
def test_sufficient_parameters(spark, predicate, params, ok):
    assert exploded(spark, {"column": "c", "predicate_type": predicate, "parameters": params})[0]["executable"] is ok


def exploded(spark, *rules):
    raw = spark.createDataFrame([("s", json.dumps({"rules": rules}))], "set_id string, raw_response string")
    return explode_rules(parse_rulesets(raw), ["set_id"]).orderBy("pos").collect()


def test_validation_keeps_what_it_can(spark):
    got, listed, blank, unknown, odd = exploded(
        spark, {"column": " c\t", "predicate_type": "NOT_NULL ", "severity": "fatal", "parameters": 3, "rule_id": 0}, [1], {"rule_id": "x", "column": 5, "severity": "warn"},
        {"rule_id": "x", "column": " d", "predicate_type": "magic", "severity": "warn", "parameters": {"min": 1}}, {"rule_id": False, "column": "e", "predicate_type": "regex", "parameters": {"pattern": "[a-z]+"}},
    )
    assert (got["rule_id"], got["column"], got["predicate"], got["severity"], got["params"], got["executable"]) == ("rule_0", "c", "not_null", "reject", "{}", True)
    assert got["note"] == "unknown dimension; unknown severity; parameters are not an object"
    assert (listed["rule_id"], listed["column"], listed["executable"], listed["note"]) == ("unparsed_1", "", False, "not an object")
    assert (blank["rule_id"], blank["predicate"], blank["severity"], blank["note"]) == ("unparsed_2", "not_null", "reject", "no column")
    assert (unknown["rule_id"], unknown["column"], unknown["params"], unknown["executable"]) == ("unparsed_3", "d", "{}", False)
    assert (odd["rule_id"], odd["executable"]) == ("rule_4", True)


def test_masks_are_two_valued_and_retention_is_monotone(spark):
    from rulesieve.operators.retention import Placed, set_retention

    df = spark.range(1000).select((F.col("id") % 17).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") % 3).alias("b"))
    rules = [Rule("a", "range", {"min": 3}, "x"), Rule("b", "not_null", {}, "y"), Rule("a", "cross_column", {"op": ">", "other_column": "b"}, "z")]
    kept = [r["set_retention"] for r in set_retention(df, [Placed(str(n), i, r) for n in range(1, 4) for i, r in enumerate(rules[:n])]).orderBy("set_id").collect()]
    assert kept == sorted(kept, reverse=True) and 0 < kept[-1] < 1
