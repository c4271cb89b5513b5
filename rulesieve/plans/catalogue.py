"""The registered queries with the SQL that must give the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions.rules import Rule, canonical, expectation, sql_check
from ..functions.scalars import sql_literal
from ..operators import census, downstream, notebooks, parsing, payload, reporting, retention, runlog, similarity, splitting, taxonomy
from ..session import local_rows
from ..sources import corpora

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def keep(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def one(name: str, tests: dict[str, tuple[str, Rule, str]], prepare=None, source: str | None = None) -> None:
    """Register a retention query: rule id -> (table, rule, SQL test)."""
    tables = {t for t, _, _ in tests.values()}
    assert len(tables) == 1
    t = tables.pop()
    rules = [Rule(r.column, r.predicate, r.params, i) for i, (_, r, _) in tests.items()]
    sql = " UNION ALL ".join(f"SELECT '{i}' AS rule_id, {keep(test)} AS retention FROM {source or t}" for i, (_, _, test) in tests.items())

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, t) if prepare is None else prepare(spark, sf)
        return retention.retention_frame(df, rules)

    query(name, sql)(run)


# ---------------------------------------------------------------- rule predicates

LABELLED = "(SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
EVENTS = "(SELECT *, CASE WHEN event_id % 7 = 0 THEN 'abc' WHEN event_id % 11 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events)"


def labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")


def events(spark, sf):
    k = F.when(F.col("event_id") % 7 == 0, "abc").when(F.col("event_id") % 11 == 0, None).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").withColumn("k", k)


one("r00_missing_column", {"absent": ("region", Rule("nowhere", "not_null"), "TRUE"), "name": ("region", Rule("r_name", "not_null"), "r_name IS NOT NULL")})
QUERIES["r00_missing_column"] = lambda spark, sf: table(spark, sf, "region").agg(
    *[F.avg(m.cast("double")).alias(n) for n, m in (("absent", retention.mask(table(spark, sf, "region"), Rule("nowhere", "not_null"))), ("name", retention.mask(table(spark, sf, "region"), Rule("r_name", "not_null"))))]
)
ORACLES["r00_missing_column"] = f"SELECT 1.0::DOUBLE AS absent, {keep('r_name IS NOT NULL')} AS name FROM region"
one("r01_not_null", {"quality": ("documents", Rule("quality", "not_null"), "quality IS NOT NULL"), "lang": ("documents", Rule("lang", "not_null"), "lang IS NOT NULL")}, labelled, LABELLED)
one("r02_in_set_str", {"status": ("orders", Rule("o_orderstatus", "in_set", {"allowed": ["F", "O"]}), "o_orderstatus IN ('F','O')"), "number": ("orders", Rule("o_orderstatus", "in_set", {"allowed": [1]}), "FALSE")})
one("r02_in_set_num", {"size": ("part", Rule("p_size", "in_set", {"allowed": [1, 2.0, 3, "4"]}), "p_size IN (1,2,3)")})
_FLAGS = "(SELECT c_acctbal >= 0 AS good, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer)"


def flags(spark, sf):
    return table(spark, sf, "customer").select((F.col("c_acctbal") >= 0).alias("good"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("segment"))


one("r02_in_set_bool", {
    "true": ("customer", Rule("good", "in_set", {"allowed": [True]}), "good"), "one": ("customer", Rule("good", "in_set", {"allowed": [1, "x"]}), "good"),
    "both": ("customer", Rule("good", "in_set", {"allowed": [0, True]}), "good IS NOT NULL"), "text": ("customer", Rule("good", "in_set", {"allowed": ["true"]}), "FALSE"),
}, flags, _FLAGS)
one("r02_in_set_null", {
    "with_null": ("customer", Rule("segment", "in_set", {"allowed": [None, "BUILDING", "AUTOMOBILE"]}), "segment IN ('BUILDING','AUTOMOBILE')"),
    "only_null": ("customer", Rule("segment", "in_set", {"allowed": [None]}), "FALSE"), "empty": ("customer", Rule("segment", "in_set", {"allowed": []}), "FALSE"),
}, flags, _FLAGS)
one("r02_in_set_mixed", {"k": ("events", Rule("k", "in_set", {"allowed": [1, 2, "abc"]}), "k = 'abc' OR TRY_CAST(k AS DOUBLE) IN (1,2)")}, events, EVENTS)
one("r03_range_num", {"both": ("customer", Rule("c_acctbal", "range", {"min": 0, "max": 5000}), "c_acctbal BETWEEN 0 AND 5000"), "low": ("customer", Rule("c_acctbal", "range", {"min": 0}), "c_acctbal >= 0")})
one("r03_range_text", {"k": ("events", Rule("k", "range", {"min": 10, "max": 60}), "TRY_CAST(k AS DOUBLE) BETWEEN 10 AND 60"), "text": ("events", Rule("event_type", "range", {"min": 0}), "FALSE")}, events, EVENTS)
one("r04_range_epoch", {
    "s_ms": ("lineitem", Rule("l_shipdate", "range", {"min": 788918400, "max": 852076800000}), "l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate <= TIMESTAMP '1997-01-01'"),
    "nonsense": ("lineitem", Rule("l_shipdate", "range", {"min": 5}), "FALSE"),
})
one("r05_regex_null", {
    "null_is_nan": ("customer", Rule("segment", "regex", {"pattern": "nan|B.*"}), "segment IS NULL OR segment LIKE 'B%'"), "no_null": ("customer", Rule("segment", "regex", {"pattern": "[A-Z]+"}), "regexp_full_match(segment, '[A-Z]+')"),
}, flags, _FLAGS)
one("r05_regex", {
    "full": ("customer", Rule("c_name", "regex", {"pattern": "Customer#[0-9]+"}), "regexp_full_match(c_name, 'Customer#[0-9]+')"),
    "part": ("customer", Rule("c_name", "regex", {"pattern": "Customer"}), "regexp_full_match(c_name, 'Customer')"),
})
one("r06_unique", {"text": ("documents", Rule("text", "unique"), "n = 1")}, None, "(SELECT count(*) OVER (PARTITION BY text) AS n FROM documents)")
DATES = "(SELECT l.l_shipdate, o.o_orderdate, CASE WHEN l.l_orderkey % 7 = 0 THEN NULL ELSE l.l_quantity END AS a, l.l_extendedprice / 1000 AS b FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"


def dates(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_shipdate", "o_orderdate", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("a"), (F.col("l_extendedprice") / 1000).alias("b"))


for _op, _name, _sql in (("<", "lt", "a < b"), ("<=", "le", "a <= b"), (">", "gt", "a > b"), (">=", "ge", "a >= b"), ("==", "eq", "a = b"), ("!=", "ne", "a <> b OR a IS NULL")):
    one(f"r07_cross_column_{_name}", {
        "numbers": ("lineitem", Rule("a", "cross_column", {"op": _op, "other_column": "b"}), _sql),
        "dates": ("lineitem", Rule("l_shipdate", "cross_column", {"op": _op, "other_column": "o_orderdate"}), _sql.split(" OR ")[0].replace("a ", "l_shipdate ").replace(" b", " o_orderdate")),
        "unknown": ("lineitem", Rule("a", "cross_column", {"op": "~", "other_column": "b"}), "TRUE"),
    }, dates, DATES)
one("r08_type_numeric", {
    "k": ("events", Rule("k", "type", {"expected": "int"}), "TRY_CAST(k AS DOUBLE) IS NOT NULL"), "kind": ("events", Rule("event_type", "type", {"expected": "numeric"}), "FALSE"),
    "any": ("events", Rule("event_type", "type", {"expected": "string"}), "TRUE"),
}, events, EVENTS)
one("r09_skipped", {"value": ("events", Rule("value", "range", {"min": 0}), "value >= 0")})
_skipping = QUERIES["r09_skipped"]
QUERIES["r09_skipped"] = lambda spark, sf: retention.retention_frame(
    table(spark, sf, "events"), [Rule("value", "range", {"min": 0}, "value"), Rule("event_type", "regex", {"pattern": "[[a"}, "broken"), Rule("event_type", "cross_column", {"op": "<", "other_column": "value"}, "no_order")]
)

TARGETS = [
    Rule("c", "not_null", {}, "a"), Rule("c", "in_set", {"allowed": ["x", "it's", 3]}, "b"), Rule("c", "range", {"min": 0, "max": 9.5}, "c"), Rule("c", "regex", {"pattern": "A.*"}, "d"),
    Rule("c", "unique", {}, "e"), Rule("c", "cross_column", {"op": "<=", "other_column": "d"}, "f"), Rule("c", "type", {"expected": "int"}, "g"),
]


@query("c01_sql_text", """SELECT * FROM (VALUES ('a','`c` IS NOT NULL'),('b','`c` IN (''x'', ''it''''s'', 3)'),('c','`c` >= 0 AND `c` <= 9.5'),('d','`c` RLIKE ''A.*'''),
('e','TRUE'),('f','`c` <= `d`'),('g','CAST(`c` AS DOUBLE) IS NOT NULL')) AS t(rule_id, check_sql)""")
def c01(spark, sf):
    return spark.createDataFrame([(r.rule_id, sql_check(r)) for r in TARGETS], "rule_id string, check_sql string")


_LITERALS = [None, True, 3, 2.5, "it's", "a\\b"]


@query("c02_literals", r"SELECT * FROM (VALUES (0,'NULL'),(1,'TRUE'),(2,'3'),(3,'2.5'),(4,chr(39) || 'it' || chr(39) || chr(39) || 's' || chr(39)),(5,chr(39) || 'a\\b' || chr(39))) AS t(i, literal)")
def c02(spark, sf):
    return spark.createDataFrame([(i, sql_literal(v)) for i, v in enumerate(_LITERALS)], "i int, literal string")


@query("c02_literals_read_back", r"SELECT * FROM (VALUES ('it''s', 'a\b')) AS t(quoted, escaped)")
def c02b(spark, sf):
    return spark.sql(f"SELECT {sql_literal(_LITERALS[4])} AS quoted, {sql_literal(_LITERALS[5])} AS escaped")


@query("c03_check_filter", "SELECT count(*) FILTER (WHERE c_acctbal >= 0 AND c_acctbal <= 5000) AS n FROM customer")
def c03(spark, sf):
    return table(spark, sf, "customer").filter(sql_check(Rule("c_acctbal", "range", {"min": 0, "max": 5000}))).agg(F.count(F.lit(1)).alias("n"))


_EXPECTED = {
    "a": ("expect_column_values_to_not_be_null", '"column": "c"'), "b": ("expect_column_values_to_be_in_set", '"column": "c", "value_set": ["x", "it\'\'s", 3]'),
    "c": ("expect_column_values_to_be_between", '"column": "c", "max_value": 9.5, "min_value": 0'), "d": ("expect_column_values_to_match_regex", '"column": "c", "regex": "A.*"'),
    "e": ("expect_column_values_to_be_unique", '"column": "c"'), "f": ("expect_column_pair_values_a_to_be_greater_than_b", '"column_A": "c", "column_B": "d"'),
    "g": ("expect_column_values_to_not_be_null", '"column": "c"'),
}


@query("c04_expectations", "SELECT * FROM (VALUES " + ",".join(
    f"""('{i}', '{{"expectation_type": "{t}", "kwargs": {{{k}}}, "meta": {{"dimension": "validity", "rule_id": "{i}"}}}}')""" for i, (t, k) in _EXPECTED.items()) + ") AS t(rule_id, expectation)")
def c04(spark, sf):
    return spark.createDataFrame([(r.rule_id, json.dumps(expectation(r), sort_keys=True)) for r in TARGETS], "rule_id string, expectation string")


# ---------------------------------------------------------------- parsing

RESPONSES = [
    ("s01", 'Here you go.\n```json\n{"rules":[{"rule_id":"a","column":"c_acctbal","dimension":"validity","predicate_type":"range","parameters":{"min":0},"severity":"reject"},{"rule_id":"b","column":"nowhere","predicate_type":"not_null","parameters":{}}]}\n```'),
    ("s02", 'I think {"rules":[{"column":"c_mktsegment","predicate_type":" In_Set ","parameters":{"allowed":["A","}"]},"severity":"warn","dimension":"validity"}]} is best.'),
    ("s03", "I cannot help with that."),
    ("s04", ""),
    ("s05", '```json\n{"rules": [1, {"column": 5}]}\n```'),
    ("s06", '{"rules": {"a": 1}}'),
    ("s07", '{"rules": [{"column": "x", "predicate_type": "range", "parameters": {}}, {"column": "x", "predicate_type": "regex", "parameters": {"pattern": "[[a"}}, {"column": "x", "predicate_type": "magic"}]}'),
    ("s08", '{"rules": [{"column"'),
    ("s09", '```\n[1, 2]\n```'),
    ("s10", '{"rules": [{"rule_id": 7, "column": " c_acctbal ", "predicate_type": "RANGE", "parameters": {"max": 1e9}, "severity": " Warn"}, {"rule_id": "n", "column": " ", "predicate_type": "unique", "severity": "warn"}, '
     '{"rule_id": "m", "column": " y ", "predicate_type": 3, "severity": "warn"}, {"rule_id": 0, "column": "z", "predicate_type": "type", "parameters": [1]}, {"rule_id": [], "column": "z", "predicate_type": "range", "parameters": {"min": true}}]}'),
]


def responses(spark):
    return spark.createDataFrame(RESPONSES, "set_id string, raw_response string")


@query("p01_parse_ruleset", """SELECT * FROM (VALUES ('s01',NULL,2),('s02',NULL,1),('s03','no JSON object',0),('s04','no JSON object',0),('s05',NULL,2),
('s06','rules is not a list',0),('s10',NULL,5),('s07',NULL,3),('s08','no JSON object',0),('s09','not an object',0)) AS t(set_id, parse_error, n_rules)""")
def p01(spark, sf):
    return parsing.parse_rulesets(responses(spark)).select("set_id", "parse_error", F.size("rules_json").alias("n_rules"))


@query("p06_validate_rules", """SELECT * FROM (VALUES ('s01',0,'a','c_acctbal','range','reject',TRUE),('s01',1,'b','nowhere','not_null','reject',TRUE),('s02',0,'rule_0','c_mktsegment','in_set','warn',TRUE),
('s05',0,'unparsed_0','','not_null','reject',FALSE),('s05',1,'unparsed_1','','not_null','reject',FALSE),('s07',0,'rule_0','x','range','reject',FALSE),('s07',1,'rule_1','x','regex','reject',FALSE),
('s07',2,'unparsed_2','x','not_null','reject',FALSE),('s10',0,'7','c_acctbal','range','warn',TRUE),('s10',1,'unparsed_1','','not_null','reject',FALSE),('s10',2,'unparsed_2','y','not_null','reject',FALSE),
('s10',3,'rule_3','z','type','reject',FALSE),('s10',4,'rule_4','z','range','reject',TRUE)) AS t(set_id, pos, rule_id, "column", predicate, severity, executable)""")
def p06(spark, sf):
    return parsing.explode_rules(parsing.parse_rulesets(responses(spark)), ["set_id"]).select("set_id", "pos", "rule_id", "column", "predicate", "severity", "executable")


@query("p09_response_hash", "SELECT conv_id, turn, sha256(coalesce(text, '')) AS response_sha256 FROM conversations WHERE role = 'assistant'")
def p09(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("response_sha256"))


@query("p02_json_validity", "SELECT turn, count(*) AS n, 0.0::DOUBLE AS valid_rate, NULL::DOUBLE AS mean_rules FROM conversations WHERE role = 'assistant' GROUP BY turn")
def p02(spark, sf):
    return parsing.validity_rates(table(spark, sf, "conversations").filter("role = 'assistant'"), ["turn"], "text")


RUNS = """(VALUES ('bank','A2','m1',1,0.0,'w',TRUE,100,4095,0.5),('bank','A2','m1',2,0.0,'w',FALSE,100,10,NULL),('bank','A4','m2',1,0.0,'w',TRUE,NULL,900,0.25),('retail','A2','m2',1,0.0,'w',TRUE,300,4090,1.125),
('retail','A4','m1',1,0.0,'w',FALSE,50,NULL,0.125),('retail','A4','mock',1,0.0,'w',TRUE,10,10,NULL)) AS t(corpus, condition, model, seed, temperature, variant, ok, input_tokens, output_tokens, cost_usd)"""


def runs(spark):
    return spark.sql(f"SELECT corpus, condition, model, seed, CAST(temperature AS DOUBLE) temperature, variant, ok, input_tokens, output_tokens, CAST(cost_usd AS DOUBLE) cost_usd FROM {RUNS}")


@query("p12_truncation", f"SELECT corpus, condition, model, seed FROM {RUNS} WHERE output_tokens >= 4088")
def p12(spark, sf):
    return runs(spark).filter(parsing.truncated(F.col("output_tokens"), F.lit(4096))).select("corpus", "condition", "model", "seed")


@query("p12_headroom", f"SELECT corpus, condition, max(output_tokens)::BIGINT AS max_tokens, (4096 - max(output_tokens))::BIGINT AS headroom FROM {RUNS} GROUP BY corpus, condition")
def p12b(spark, sf):
    return parsing.headroom(runs(spark), 4096)


@query("p13_trap_rules", "SELECT * FROM (VALUES ('s01','a'),('s10','7')) AS t(set_id, rule_id)")
def p13(spark, sf):
    traps = spark.createDataFrame([("c_acctbal",)], "column string")
    return parsing.explode_rules(parsing.parse_rulesets(responses(spark)), ["set_id"]).join(F.broadcast(traps), "column").select("set_id", "rule_id")


# ---------------------------------------------------------------- taxonomy, similarity

CODED = {
    "set_id": "q1",
    "rules": [
        {"rule_id": "k0", "column": "c_acctbal", "predicate_type": "range", "parameters": {"min": 0}, "severity": "reject"},
        {"rule_id": "k1", "column": "c_acctbal", "predicate_type": "range", "parameters": {"min": 0.0}, "severity": "warn"},
        {"rule_id": "k2", "column": "ghost", "predicate_type": "not_null", "parameters": {}},
        {"rule_id": "k3", "column": "c_mktsegment", "predicate_type": "in_set", "parameters": {"allowed": ["NOWHERE"]}},
        {"rule_id": "k4", "column": "c_acctbal", "predicate_type": "regex", "parameters": {"pattern": ".*"}},
        {"rule_id": "k5", "column": "c_acctbal", "predicate_type": "range", "parameters": {"min": 99999}},
        {"rule_id": "k6", "column": "c_nationkey", "predicate_type": "range", "parameters": {"min": 3}, "severity": "quarantine"},
        {"rule_id": "k7", "column": "c_custkey", "predicate_type": "range", "parameters": {}},
        {"rule_id": "k8", "column": "c_name", "predicate_type": "range", "parameters": {"min": 1}},
    ],
}


SENTINELS = {"c_acctbal": [-1], "c_mktsegment": ["UNKNOWN"]}


def coded(spark, sf, vacuous=False, rules_of=CODED, sentinels=SENTINELS):
    customer = table(spark, sf, "customer")
    raw = local_rows(spark, [(rules_of["set_id"], json.dumps({"rules": rules_of["rules"]}))], "set_id string, raw_response string")
    rows = [r.asDict() for r in parsing.explode_rules(parsing.parse_rulesets(raw), ["set_id"]).collect()]  # rule-sized
    rules = [parsing.rule_of(r) for r in rows if r["executable"]]
    kept = retention.rule_retention(customer, rules)
    facts = {r["column"]: r for r in census.census(customer, True, True).collect()}  # column-sized
    levels: dict[str, list] = {}
    for r in census.top_levels(customer, ["c_mktsegment", "c_nationkey"]).orderBy("place").collect():
        levels.setdefault(r["column"], []).append(r["value"])
    schema = {c: {"kind": f["logical_type"], "min": f["min_value"], "max": f["max_value"], "levels": levels.get(c) if f["logical_type"] == "string" else None} for c, f in facts.items()}
    for r in rows:
        r["retention"] = kept.get(canonical(parsing.rule_of(r))) if r["executable"] else None
    return taxonomy.code_rules(rows, schema, sentinels, {"c_nationkey", "c_mktsegment"}, spark, vacuous)


_FACTS = "(SELECT min(c_acctbal) lo, max(c_acctbal) hi, avg((c_acctbal >= 0)::INT) k0, avg((c_nationkey >= 3)::INT) k6 FROM customer)"


@query("f_codes_all", f"""SELECT rule_id, codes FROM {_FACTS}, LATERAL (VALUES
('k0', concat_ws(',', CASE WHEN k0 < 0.5 THEN 'F4' END, 'F9')), ('k1', concat_ws(',', CASE WHEN k0 < 0.5 THEN 'F4' END, 'F8', 'F9')), ('k2', 'F1'), ('k3', 'F2,F4,F9,F10'), ('k4', 'F6'),
('k5', concat_ws(',', CASE WHEN 99999 > hi THEN 'F3' END, 'F4', 'F9')), ('k6', concat_ws(',', CASE WHEN k6 < 0.5 THEN 'F4' END, CASE WHEN k6 < 1 THEN 'F10' END)), ('k7', 'F7'), ('k8', 'F4,F6')) AS t(rule_id, codes)""")
def f_all(spark, sf):
    return coded(spark, sf).select("rule_id", F.array_join("codes", ",").alias("codes"))


SENTINEL_RULES = {
    "set_id": "q2",
    "rules": [
        {"rule_id": "n0", "column": "c_name", "predicate_type": "not_null", "parameters": {}},
        {"rule_id": "n1", "column": "c_mktsegment", "predicate_type": "not_null", "parameters": {}},
        {"rule_id": "x0", "column": "c_mktsegment", "predicate_type": "regex", "parameters": {"pattern": "[A-Z]+"}},
        {"rule_id": "x1", "column": "c_name", "predicate_type": "regex", "parameters": {"pattern": "Customer#.*"}},
        {"rule_id": "o0", "column": "c_acctbal", "predicate_type": "cross_column", "parameters": {"op": "<", "other_column": "ghost"}},
        {"column": " ", "predicate_type": "unique"}, "no object", {"rule_id": "w", "column": "c_name", "predicate_type": "not_null", "parameters": {}},
    ],
}


@query("f_sentinels_vacuous", """SELECT * FROM (VALUES ('n0','F5,F9'),('n1','F5'),('x0','F5'),('x1','F5,F9'),('o0','F1,F5'),('unparsed_5','F1,F7'),('unparsed_6','F1,F7,F8'),('w','F5,F8,F9')) AS t(rule_id, codes)""")
def f_sentinels(spark, sf):
    """Null among a column's sentinels, texts that a pattern misses, and rules that reject nothing."""
    found = coded(spark, sf, True, SENTINEL_RULES, {"c_name": [None, "N/A"], "c_mktsegment": ["UNKNOWN"]})
    return found.select("rule_id", F.array_join("codes", ",").alias("codes"))


@query("f_executable", "SELECT * FROM (VALUES ('n0'),('n1'),('x0'),('x1'),('o0'),('w')) AS t(rule_id)")
def f_executable(spark, sf):
    return taxonomy.executable(coded(spark, sf, False, SENTINEL_RULES)).select("rule_id")


@query("f_code_histogram", f"""WITH c AS ({ORACLES['f_codes_all']}), k AS (SELECT * FROM (VALUES ('F1'),('F2'),('F3'),('F4'),('F5'),('F6'),('F7'),('F8'),('F9'),('F10')) AS t(code))
SELECT k.code, count(c.rule_id) AS n, 100.0::DOUBLE * count(c.rule_id) / 9 AS percent FROM k LEFT JOIN c ON list_contains(string_split(c.codes, ','), k.code) GROUP BY k.code""")
def f_hist(spark, sf):
    return taxonomy.code_histogram(coded(spark, sf))


@query("t_codes_per_set", f"""WITH c AS ({ORACLES['f_codes_all']}) SELECT 'q1' AS set_id, count(*) AS n_rules, {', '.join(f"count(*) FILTER (WHERE list_contains(string_split(codes, ','), 'F{i}')) AS F{i}" for i in range(1, 11))} FROM c""")
def t_codes(spark, sf):
    return taxonomy.codes_per_set(coded(spark, sf))


SETS = """(VALUES ('bank',1,'x'),('bank',1,'y'),('bank',2,'x'),('bank',3,'x'),('bank',3,'y'),('bank',3,'z'),('retail',1,NULL),('retail',2,NULL),('retail',3,'x')) AS t(corpus, seed, item)"""


def seed_sets(spark):
    return spark.sql(f"SELECT * FROM {SETS}").groupBy("corpus", "seed").agg(F.collect_set("item").alias("items"))


_PAIRS = f"""WITH s AS (SELECT corpus, seed, coalesce(list(DISTINCT item) FILTER (WHERE item IS NOT NULL), []) AS items FROM {SETS} GROUP BY corpus, seed),
p AS (SELECT a.corpus, CASE WHEN len(a.items) + len(b.items) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items))) END AS j
FROM s a JOIN s b ON a.corpus = b.corpus AND a.seed < b.seed)"""


@query("k_jaccard_stability", f"{_PAIRS} SELECT corpus, avg(j) AS jaccard_mean, min(j) AS jaccard_min, 3::BIGINT AS n_seeds FROM p GROUP BY corpus")
def k_stab(spark, sf):
    return similarity.stability(seed_sets(spark), ["corpus"])


@query("k_unstable_share", f"{_PAIRS}, c AS (SELECT corpus, avg(j) AS m FROM p GROUP BY corpus) SELECT avg((m < 0.8)::INT) AS unstable_share, avg(m) AS overall_mean FROM c")
def k_share(spark, sf):
    return similarity.unstable_share(similarity.stability(seed_sets(spark), ["corpus"]))


ORDER_RULES = [
    Rule("o_totalprice", "range", {"min": 1000}, "price"), Rule("o_orderstatus", "in_set", {"allowed": ["F", "O"]}, "status"),
    Rule("o_orderpriority", "in_set", {"allowed": ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]}, "priority"), Rule("o_orderkey", "not_null", {}, "key"),
]
_TESTS = {"price": "o_totalprice >= 1000", "status": "o_orderstatus IN ('F','O')", "priority": "o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM','5-LOW')", "key": "o_orderkey IS NOT NULL"}
_RET = " UNION ALL ".join(f"SELECT '{k}' AS rule_id, {keep(t)} AS retention FROM orders" for k, t in _TESTS.items())


@query("t_rule_retention", _RET)
def t_rule(spark, sf):
    return retention.retention_frame(table(spark, sf, "orders"), ORDER_RULES)


PLACED = [retention.Placed("all", i, r) for i, r in enumerate(ORDER_RULES)] + [
    retention.Placed("few", 0, ORDER_RULES[0]), retention.Placed("few", 1, Rule("o_orderstatus", "range", {"min": 1}, "bad"), True, True), retention.Placed("none", 0, ORDER_RULES[1], False),
]


@query("t_set_retention", f"""SELECT 'all' AS set_id, {keep(' AND '.join(_TESTS.values()))} AS set_retention, {keep(' AND '.join(_TESTS.values()))} AS set_retention_ex_f6, 0::BIGINT AS n_f6 FROM orders
UNION ALL SELECT 'few', 0.0, {keep(_TESTS['price'])}, 1 FROM orders UNION ALL SELECT 'none', 1.0, 1.0, 0""")
def t_set(spark, sf):
    return retention.set_retention(table(spark, sf, "orders"), PLACED)


def rules_with_retention(spark, sf):
    return t_rule(spark, sf).withColumns({"set_id": F.lit("all"), "executable": F.lit(True)})


@query("t_inert_rate", f"SELECT 'all' AS set_id, avg((retention >= 1)::INT) AS inert_rate FROM ({_RET})")
def t_inert(spark, sf):
    return retention.inert_rate(rules_with_retention(spark, sf))


@query("t_independence_ratio", f"SELECT 'all' AS set_id, round(product(retention), 9) AS product, round((SELECT {keep(' AND '.join(_TESTS.values()))} FROM orders) / nullif(product(retention), 0), 9) AS independence_ratio FROM ({_RET})")
def t_ind(spark, sf):
    sets = t_set(spark, sf).join(retention.retention_product(rules_with_retention(spark, sf)), "set_id")
    return retention.independence(sets).select("set_id", F.round("product", 9).alias("product"), F.round("independence_ratio", 9).alias("independence_ratio"))


SCORED = """(SELECT corpus, condition, model, seed, set_id, CAST(a AS DOUBLE) AS set_retention, CAST(b AS DOUBLE) AS set_retention_ex_f6, F2, F4, F9 FROM (VALUES
('bank','A2','m1',1,'x1',0.0,0.5,1,0,2),('bank','A2','m1',2,'x2',0.25,0.5,0,1,1),('bank','A4','m1',1,'x3',0.75,0.75,0,0,0),('bank','A4','m2',1,'x4',0.0,0.0,3,1,1),('retail','A2','m1',1,'x5',1.0,1.0,0,0,0),
('retail','A4','m2',1,'x6',0.5,1.0,2,2,1),('retail','A4','m2',2,'x7',0.0,1.0,1,0,1)) AS t(corpus, condition, model, seed, set_id, a, b, F2, F4, F9))"""


def scored(spark):
    return spark.sql(f"SELECT * FROM {SCORED}")


@query("t_mismatch_gap", f"""SELECT corpus, condition, avg(set_retention_ex_f6 - set_retention) AS mean_gap, count(*) FILTER (WHERE set_retention = 0) AS zero_with, count(*) FILTER (WHERE set_retention_ex_f6 = 0) AS zero_without
FROM {SCORED} GROUP BY corpus, condition""")
def t_gap(spark, sf):
    return retention.mismatch_gap(scored(spark))


@query("t_summary", f"SELECT corpus, condition, model, count(*) AS n, avg(set_retention) AS mean_retention, stddev_samp(set_retention) AS sd_retention, avg(F9) AS mean_F9, avg(F4) AS mean_F4, avg(F2) AS mean_F2 FROM {SCORED} GROUP BY 1,2,3")
def t_summary(spark, sf):
    return retention.summary(scored(spark))


@query("t_ladder_pivot", f"SELECT corpus, model, avg(CASE WHEN condition='A2' THEN set_retention END) AS A2, avg(CASE WHEN condition='A4' THEN set_retention END) AS A4 FROM {SCORED} GROUP BY corpus, model")
def t_ladder(spark, sf):
    return retention.ladder(scored(spark), ["A2", "A4"])


SET_RULES = "(SELECT set_id, rule_id, CAST(r AS DOUBLE) AS retention FROM (VALUES ('x1','a',0.0),('x1','b',1.0),('x4','c',0.5),('x7','d',0.98),('x7','e',0.2),('x2','f',0.1)) AS t(set_id, rule_id, r))"


@query("t_collapse_diagnosis", f"""SELECT z.corpus, z.condition, z.model, z.set_id, r.rule_id, r.retention FROM (SELECT *, row_number() OVER (PARTITION BY corpus, condition, model ORDER BY seed, set_id) i FROM {SCORED} WHERE set_retention = 0) z
JOIN {SET_RULES} r ON r.set_id = z.set_id WHERE z.i = 1 AND r.retention < 0.99""")
def t_collapse(spark, sf):
    return retention.collapsed(scored(spark), spark.sql(f"SELECT * FROM {SET_RULES}"))


LINE_RULES = [Rule("l_discount", "range", {"min": 0.05}, "discount"), Rule("l_returnflag", "in_set", {"allowed": ["A", "N"]}, "flag"), Rule("l_quantity", "range", {"min": 1}, "quantity")]
_LTESTS = {"discount": "l_discount >= 0.05", "flag": "l_returnflag IN ('A','N')", "quantity": "l_quantity >= 1"}


@query("t_block_attribution", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS rule_id, count(*) FILTER (WHERE NOT ({t})) AS rejected, count(*) FILTER (WHERE NOT ({t}) AND l_returnflag='R')::DOUBLE / nullif(count(*) FILTER (WHERE l_returnflag='R'), 0) AS block_removed, "
    f"count(*) FILTER (WHERE NOT ({t}) AND l_returnflag='R')::DOUBLE / nullif(count(*) FILTER (WHERE NOT ({t})), 0) AS inside_block, "
    f"(count(*) FILTER (WHERE NOT ({t}) AND l_returnflag='R') > 0.95 * count(*) FILTER (WHERE l_returnflag='R') AND count(*) FILTER (WHERE NOT ({t}) AND l_returnflag='R') > 0.95 * count(*) FILTER (WHERE NOT ({t}))) AS pure FROM lineitem"
    for k, t in _LTESTS.items()) + ") WHERE rejected > 0")
def t_block(spark, sf):
    return retention.block_attribution(table(spark, sf, "lineitem"), LINE_RULES, F.col("l_returnflag") == "R")


GATES = "(SELECT condition, model, seed, CAST(x AS DOUBLE) AS block_removed FROM (VALUES ('A2','m',1,0.9),('A2','m',2,0.1),('A4','m',1,0.6),('A4','m',2,0.2),('A4','m',3,0.4)) AS t(condition, model, seed, x))"
DELTAS = "(SELECT condition, model, seed, CAST(x AS DOUBLE) AS delta FROM (VALUES ('A2','m',1,-0.25),('A2','m',2,0.0),('A4','m',1,-0.125),('A4','m',2,-0.0625)) AS t(condition, model, seed, x))"


@query("t_block_vs_delta", f"SELECT round(corr(block_removed, delta), 9) AS r, avg(delta) FILTER (WHERE block_removed > 0.5) AS mean_above, avg(delta) FILTER (WHERE block_removed <= 0.5) AS mean_below, count(*) AS n FROM {GATES} JOIN {DELTAS} USING (condition, model, seed)")
def t_delta(spark, sf):
    return retention.block_against_delta(spark.sql(f"SELECT * FROM {GATES}"), spark.sql(f"SELECT * FROM {DELTAS}")).withColumn("r", F.round("r", 9))


_OV = [(a, b) for i, a in enumerate(_TESTS) for b in list(_TESTS)[i + 1 :]]


@query("k_rejected_overlap", " UNION ALL ".join(
    f"SELECT '{a}' AS rule_a, '{b}' AS rule_b, CASE WHEN count(*) FILTER (WHERE NOT ({_TESTS[a]}) OR NOT ({_TESTS[b]})) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (WHERE NOT ({_TESTS[a]}) AND NOT ({_TESTS[b]}))::DOUBLE / count(*) FILTER (WHERE NOT ({_TESTS[a]}) OR NOT ({_TESTS[b]})) END AS jaccard FROM orders" for a, b in _OV))
def k_overlap(spark, sf):
    return retention.rejected_overlap(table(spark, sf, "orders"), ORDER_RULES)


@query("k_coincidence", "SELECT count(*) FILTER (WHERE o_orderstatus='F' AND o_totalprice > 100000) AS intersection, count(*) FILTER (WHERE o_orderstatus='F' OR o_totalprice > 100000) AS \"union\", count(*) FILTER (WHERE o_orderstatus='F' AND o_totalprice > 100000)::DOUBLE / nullif(count(*) FILTER (WHERE o_orderstatus='F' OR o_totalprice > 100000), 0) AS jaccard, (count(*) FILTER (WHERE o_orderstatus='F') = count(*) FILTER (WHERE o_orderstatus='F' OR o_totalprice > 100000) AND count(*) FILTER (WHERE o_totalprice > 100000) = count(*) FILTER (WHERE o_orderstatus='F' OR o_totalprice > 100000)) AS all_equal FROM orders")
def k_coincidence(spark, sf):
    return retention.coincidence(table(spark, sf, "orders"), {"f": F.col("o_orderstatus") == "F", "high": F.col("o_totalprice") > 100000})


@query("t_rule_export", f"SELECT e.set_id, e.rule_id, r.retention FROM (VALUES ('all','price'),('all','status'),('all','ghost')) AS e(set_id, rule_id) LEFT JOIN ({_RET}) r ON r.rule_id = e.rule_id")
def t_export(spark, sf):
    rules = spark.createDataFrame([("all", "price"), ("all", "status"), ("all", "ghost")], "set_id string, rule_id string")
    return rules.join(t_rule(spark, sf), "rule_id", "left").select("set_id", "rule_id", "retention")


# ---------------------------------------------------------------- census, splits, payloads

CENSUS = {
    "customer": {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "float", "c_mktsegment": "string"},
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "float", "o_orderdate": "timestamp", "o_orderpriority": "string"},
    "part": {"p_partkey": "int", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "float"},
    "supplier": {"s_suppkey": "int", "s_name": "string", "s_nationkey": "int", "s_acctbal": "float"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
}


def _census_sql(t: str, columns: dict[str, str]) -> str:
    rows = []
    for c, kind in columns.items():
        number = kind in ("int", "float")
        q = [f"quantile_cont({c}::DOUBLE, {x})" if number else "NULL::DOUBLE" for x in (0.01, 0.25, 0.5, 0.75, 0.99)]
        lo, hi = (f"min({c})::DOUBLE", f"max({c})::DOUBLE") if number else ("NULL::DOUBLE", "NULL::DOUBLE")
        rows.append(
            f"SELECT '{c}' AS \"column\", '{kind}' AS logical_type, 1 - count({c})::DOUBLE / count(*) AS null_rate, count(DISTINCT {c}) AS distinct_count, {lo} AS min_value, {hi} AS max_value, "
            + ", ".join(f"round({x}, 6) AS q{n}" for x, n in zip(q, ("01", "25", "50", "75", "99"), strict=True)) + f" FROM {t}"
        )
    return " UNION ALL ".join(rows)


for _t, _columns in CENSUS.items():

    def _census(spark, sf, t=_t, names=tuple(_columns)):
        df = census.census(table(spark, sf, t).select(*names), True, True)
        return df.withColumns({f"q{n}": F.round(f"q{n}", 6) for n in ("01", "25", "50", "75", "99")})

    query(f"n_census_{_t}", _census_sql(_t, _columns))(_census)


def _levels_sql(t: str, columns: list[str], limit: int) -> str:
    cells = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS value FROM {t} WHERE {c} IS NOT NULL" for c in columns)
    return f"SELECT * FROM (SELECT \"column\", value, n, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM (SELECT \"column\", value, count(*) AS n FROM ({cells}) GROUP BY 1, 2)) WHERE place <= {limit}"


_LC = ["o_custkey", "o_orderstatus", "o_orderpriority"]


@query("n_top_levels", _levels_sql("orders", _LC, 20))
def n_levels(spark, sf):
    return census.top_levels(table(spark, sf, "orders"), _LC)


@query("n_modal", f"SELECT \"column\", value, n::DOUBLE / (SELECT count(*) FROM orders) AS rate FROM ({_levels_sql('orders', _LC, 1)})")
def n_modal(spark, sf):
    return census.modal_values(table(spark, sf, "orders"), _LC)


@query("n_without_levels", "SELECT 'empty' AS \"column\" FROM region LIMIT 1")
def n_without(spark, sf):
    return census.without_levels(table(spark, sf, "region").withColumn("empty", F.lit(None).cast("string")))


@query("n_doc_coverage", "SELECT 'r_name' AS documented, 1::BIGINT AS n_documented, 'r_regionkey' AS undocumented, 1::BIGINT AS n_undocumented, 'ghost' AS orphaned, 1::BIGINT AS n_orphaned, 0.5::DOUBLE AS coverage")
def n_coverage(spark, sf):
    columns = spark.createDataFrame([("r_regionkey",), ("r_name",)], "column string")
    return census.doc_coverage(columns, spark.createDataFrame([("r_name", "Name of the region"), ("ghost", "x"), ("r_regionkey", " ")], "column string, doc string"))


_SPLIT = "(SELECT *, row_number() OVER (ORDER BY md5('20260807:' || o_orderkey::VARCHAR), o_orderkey) <= round_even(0.2 * count(*) OVER (), 0) AS authoring FROM orders)"


def split_orders(spark, sf):
    return splitting.split(table(spark, sf, "orders"), "o_orderkey")


@query("x_split", f"SELECT o_orderkey, authoring FROM {_SPLIT}")
def x_split(spark, sf):
    return split_orders(spark, sf).select("o_orderkey", "authoring")


@query("x_split_manifest", f"""SELECT authoring AS part, count(*) AS n, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id,
sum(('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT::HUGEINT)::VARCHAR || '-' || sum(('0x' || substr(md5(o_orderkey::VARCHAR), 9, 8))::BIGINT::HUGEINT)::VARCHAR AS digest FROM {_SPLIT} GROUP BY authoring""")
def x_manifest(spark, sf):
    return splitting.manifest(split_orders(spark, sf), "o_orderkey", "authoring")


@query("x_split_check", "SELECT count(*) AS total, round_even(0.2 * count(*), 0)::BIGINT AS a, (count(*) - round_even(0.2 * count(*), 0))::BIGINT AS b, TRUE AS disjoint, TRUE AS exhaustive, TRUE AS fraction_ok FROM orders")
def x_check(spark, sf):
    parts = split_orders(spark, sf)
    return splitting.check_split(table(spark, sf, "orders"), parts.filter("authoring"), parts.filter("NOT authoring"), "o_orderkey")


@query("x_split_downstream", "SELECT c_custkey, row_number() OVER (ORDER BY md5('downstream:' || c_custkey::VARCHAR), c_custkey) <= round_even(0.3 * count(*) OVER (), 0) AS test FROM customer")
def x_downstream(spark, sf):
    return splitting.split(table(spark, sf, "customer"), "c_custkey", 0.30, "downstream", "test").select("c_custkey", "test")


@query("x_subsample", "SELECT o_orderkey FROM orders ORDER BY md5('sub:' || o_orderkey::VARCHAR), o_orderkey LIMIT 500")
def x_sub(spark, sf):
    return splitting.sample(table(spark, sf, "orders"), "o_orderkey", 500, "sub").select("o_orderkey")


@query("x_payload_rows", "SELECT c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 200) ORDER BY md5('20260807:' || c_custkey::VARCHAR), c_custkey LIMIT 20")
def x_payload(spark, sf):
    return splitting.payload_rows(table(spark, sf, "customer"), "c_custkey").select("c_custkey", "c_name")


@query("x_counterfactuals", """WITH s AS (SELECT count(*) FILTER (WHERE c_acctbal < 0) AS k FROM customer), r AS (SELECT c_custkey, c_acctbal < 0 AS drop_block, row_number() OVER (ORDER BY md5('20260807:' || c_custkey::VARCHAR), c_custkey) AS i,
row_number() OVER (PARTITION BY c_acctbal < 0 ORDER BY md5('20260807:outside:' || c_custkey::VARCHAR), c_custkey) AS j FROM customer) SELECT c_custkey, drop_block, i <= k AS drop_random, NOT drop_block AND j <= k AS drop_outside FROM r, s""")
def x_counter(spark, sf):
    return splitting.counterfactuals(table(spark, sf, "customer"), "c_custkey", F.col("c_acctbal") < 0).select("c_custkey", "drop_block", "drop_random", "drop_outside")


@query("x_bootstrap", f"SELECT round(avg(set_retention), 9) AS mean, TRUE AS in_order, TRUE AS inside FROM {SCORED}")
def x_bootstrap(spark, sf):
    values = [r[0] for r in scored(spark).select("set_retention").collect()]
    found = spark.createDataFrame([splitting.bootstrap_ci(values)], "mean double, low double, high double")
    ordered = (F.col("low") < F.col("mean")) & (F.col("mean") < F.col("high"))
    return found.select(F.round("mean", 9).alias("mean"), ordered.alias("in_order"), ((F.col("low") >= min(values)) & (F.col("high") <= max(values))).alias("inside"))


@query("b_schema_payload", "SELECT 'Table: nation' || chr(10) || chr(10) || 'Columns:' || chr(10) || '  n_nationkey: int' || chr(10) || '  n_name: string' || chr(10) || '  n_regionkey: int' AS payload")
def b_schema(spark, sf):
    df = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    places = spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column string, place int")
    return payload.schema_lines(census.census(df, True, True).join(F.broadcast(places), "column"), "nation")


@query("b_sample_lines", """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","nothing":null}' AS line
FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 200) ORDER BY md5('20260807:' || c_custkey::VARCHAR), c_custkey LIMIT 20""")
def b_samples(spark, sf):
    return payload.sample_lines(x_payload(spark, sf).withColumn("nothing", F.lit(None).cast("string")))


@query("b_leakage_flags", "SELECT * FROM (VALUES (1, FALSE), (2, TRUE), (3, TRUE)) AS t(id, leaks)")
def b_leaks(spark, sf):
    return spark.createDataFrame([(1, "null 0.00%; 5 distinct"), (2, "-1 is a SENTINEL"), (3, "this encodes missing data")], "id int, text string").select("id", payload.leaks("text").alias("leaks"))


PROMPTS = "(VALUES ('bank','A2','sys','hello world'),('bank','A4','sys','hello world and more')) AS t(corpus, condition, system, \"user\")"


@query("b_prompt_stats", f"SELECT corpus, condition, length(\"user\") AS chars, length(\"user\") // 4 AS tokens, sha256(system || chr(10) || \"user\") AS hash FROM {PROMPTS}")
def b_stats(spark, sf):
    return payload.prompt_stats(spark.sql("SELECT * FROM VALUES ('bank','A2','sys','hello world'),('bank','A4','sys','hello world and more') AS t(corpus, condition, system, user)"))


# ---------------------------------------------------------------- run log

@query("l_plan", "SELECT c.corpus, d.condition, m.model, s.seed FROM (VALUES ('bank'),('retail')) c(corpus), (VALUES ('A2'),('A4')) d(condition), (VALUES ('m1'),('m2')) m(model), (VALUES (1),(2)) s(seed)")
def l_plan(spark, sf):
    v = lambda name, values: spark.createDataFrame([(x,) for x in values], f"{name} {'int' if name == 'seed' else 'string'}")
    return runlog.plan(v("corpus", ["bank", "retail"]), v("condition", ["A2", "A4"]), v("model", ["m1", "m2"]), v("seed", [1, 2]))


@query("l_resume_plan", f"SELECT p.* FROM ({ORACLES['l_plan']}) p WHERE NOT EXISTS (SELECT 1 FROM {RUNS} WHERE ok AND t.corpus = p.corpus AND t.condition = p.condition AND t.model = p.model AND t.seed = p.seed)")
def l_resume(spark, sf):
    return runlog.pending(l_plan(spark, sf), runs(spark), ["corpus", "condition", "model", "seed"])


@query("l_runlog_summary", f"SELECT model, count(*) AS runs, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, round(coalesce(sum(cost_usd::DOUBLE), 0), 4) AS spend FROM {RUNS} GROUP BY model")
def l_summary(spark, sf):
    return runlog.log_summary(runs(spark))


@query("l_ok_by_cell", f"SELECT corpus, model, count(*) FILTER (WHERE ok) AS n_ok, count(*) AS n FROM {RUNS} GROUP BY corpus, model")
def l_ok(spark, sf):
    return runlog.ok_by_cell(runs(spark))


@query("l_cost", f"SELECT corpus, condition, r.model, seed, round((input_tokens * p.price_in + output_tokens * p.price_out) / 1e6, 9) AS cost FROM (SELECT * FROM {RUNS}) r LEFT JOIN (VALUES ('m1', 3.0::DOUBLE, 15.0::DOUBLE)) p(model, price_in, price_out) ON p.model = r.model")
def l_cost(spark, sf):
    prices = spark.createDataFrame([("m1", 3.0, 15.0)], "model string, price_in double, price_out double")
    return runlog.with_cost(runs(spark), prices).select("corpus", "condition", "model", "seed", F.round("cost", 9).alias("cost"))


@query("l_without_mocks", f"SELECT corpus, model FROM {RUNS} WHERE model <> 'mock'")
def l_mocks(spark, sf):
    return runlog.without_mocks(runs(spark)).select("corpus", "model")


@query("l_run_key", f"SELECT concat_ws('|', corpus, condition, model, seed::VARCHAR, variant) AS run_key FROM {RUNS}")
def l_key(spark, sf):
    return runs(spark).select(runlog.run_key("corpus", "condition", "model", "seed", "variant").alias("run_key"))


@query("l_execute_mock", f"SELECT *, TRUE AS ok, 1 AS attempts, length(concat_ws('|', corpus, condition, model, seed::VARCHAR, '0.0', 'w')) // 4 AS input_tokens, 1 AS rule_sets FROM ({ORACLES['l_resume_plan']})")
def l_execute(spark, sf):
    planned = l_resume(spark, sf).withColumns({"temperature": F.lit(0.0), "variant": F.lit("w"), "seed": F.col("seed").cast("long")})
    done = runlog.execute(planned).withColumn("rules", F.size(F.from_json("raw_response", "rules array<struct<rule_id string>>")["rules"]))
    return done.select("corpus", "condition", "model", "seed", "ok", "attempts", "input_tokens", F.col("rules").between(1, 3).cast("int").alias("rule_sets"))


@query("l_cost_per_million", "SELECT * FROM (VALUES (1, 2.0::DOUBLE), (2, 'inf'::DOUBLE)) AS t(id, cost)")
def l_million(spark, sf):
    d = spark.createDataFrame([(1, 1.0, 500000), (2, 1.0, 0)], "id int, c double, n long")
    return d.select("id", downstream.cost_per_million(F.col("c"), F.col("n")).alias("cost"))


# ---------------------------------------------------------------- downstream

SCORES = "(SELECT c_custkey, c_mktsegment, c_nationkey, (c_acctbal > 4000)::INT AS y, ((c_custkey * 37 + c_nationkey * 11) % 50)::DOUBLE / 50 AS score FROM customer)"


def scores(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey", (F.col("c_acctbal") > 4000).cast("int").alias("y"), (((F.col("c_custkey") * 37 + F.col("c_nationkey") * 11) % 50).cast("double") / 50).alias("score"))


def _auc_sql(by: str = "") -> str:
    g, p = (f"{by}, ", f"PARTITION BY {by} ") if by else ("", "")
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {g}round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * sum(1 - y), 0), 9) AS auc, count(*) AS n, sum(y) AS pos FROM "
            f"(SELECT *, rank() OVER ({p}ORDER BY score) + (count(*) OVER (PARTITION BY {g}score) - 1) / 2.0 AS rk FROM {SCORES}){group}")


@query("m_auc", f"SELECT auc FROM ({_auc_sql()})")
def m_auc(spark, sf):
    return downstream.roc_auc(scores(spark, sf)).withColumn("auc", F.round("auc", 9))


@query("m_avg_precision", f"""WITH d AS (SELECT score, sum(y) AS p, count(*) AS n FROM {SCORES} GROUP BY score), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM d)
SELECT round(sum(p * cp::DOUBLE / cn) / sum(p), 9) AS average_precision FROM c""")
def m_ap(spark, sf):
    return downstream.average_precision(scores(spark, sf)).withColumn("average_precision", F.round("average_precision", 9))


@query("m_brier", f"SELECT round(avg(pow(score - y, 2)), 9) AS brier FROM {SCORES}")
def m_brier(spark, sf):
    return downstream.brier(scores(spark, sf)).withColumn("brier", F.round("brier", 9))


@query("m_subgroup_auc", f"SELECT c_mktsegment, auc, n FROM ({_auc_sql('c_mktsegment')}) WHERE n >= 100 AND pos > 0 AND pos < n")
def m_sub(spark, sf):
    return downstream.subgroup_auc(scores(spark, sf), "c_mktsegment").withColumn("auc", F.round("auc", 9))


@query("m_subgroup_gap", f"SELECT round(max(auc) - min(auc), 8) AS gap FROM ({ORACLES['m_subgroup_auc']})")
def m_gap(spark, sf):
    return downstream.subgroup_gap(downstream.subgroup_auc(scores(spark, sf), "c_mktsegment")).withColumn("gap", F.round("gap", 8))


@query("m_shift", """WITH b AS (SELECT c_mktsegment, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM customer GROUP BY 1), a AS (SELECT c_mktsegment, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM customer WHERE c_acctbal >= 0 GROUP BY 1)
SELECT round(sum(abs(coalesce(a.s, 0) - b.s)) / 2, 9) AS shift FROM b LEFT JOIN a USING (c_mktsegment)""")
def m_shift(spark, sf):
    c = table(spark, sf, "customer")
    return downstream.composition_shift(c, c.filter("c_acctbal >= 0"), "c_mktsegment").withColumn("shift", F.round("shift", 9))


@query("m_feasibility", """SELECT c_nationkey, n, positives, CASE WHEN n < 500 THEN 'too few rows' WHEN positives = 0 OR positives = n THEN 'one class' WHEN positives < 25 OR n - positives < 25 THEN 'too few of a class' ELSE '' END AS reason,
NOT (n < 500 OR positives = 0 OR positives = n OR positives < 25 OR n - positives < 25) AS feasible FROM (SELECT c_nationkey, count(*) AS n, sum((c_acctbal > 4000)::INT)::BIGINT AS positives FROM customer GROUP BY 1)""")
def m_feasible(spark, sf):
    return downstream.feasibility(scores(spark, sf), ["c_nationkey"])


@query("m_label_bands", "SELECT p_partkey, CASE WHEN p_size <= 0 THEN 'nan' WHEN p_size <= 30 THEN '<30' WHEN p_size <= 40 THEN '30-40' WHEN p_size <= 50 THEN '40-50' WHEN p_size <= 60 THEN '50-60' WHEN p_size <= 200 THEN '60+' ELSE 'nan' END AS band, (p_size = 5)::INT AS y FROM part")
def m_bands(spark, sf):
    return table(spark, sf, "part").select("p_partkey", downstream.age_band(F.col("p_size")).alias("band"), downstream.label(F.col("p_size"), 5).alias("y"))


@query("m_quantile_bands", "WITH e AS (SELECT list_distinct(quantile_cont(p_retailprice, [0.0,0.2,0.4,0.6,0.8,1.0])) AS q FROM part) SELECT p_partkey, greatest(len(list_filter(q, lambda x: x < p_retailprice)), 1)::VARCHAR AS band FROM part, e")
def m_quantiles(spark, sf):
    return downstream.quantile_band(table(spark, sf, "part"), "p_retailprice", "band").select("p_partkey", "band")


@query("m_first_seen_codes", "WITH f AS (SELECT o_orderpriority AS v, min(o_orderkey) AS k FROM orders GROUP BY 1), c AS (SELECT v, row_number() OVER (ORDER BY k) - 1 AS code FROM f) SELECT o_orderkey, code FROM orders JOIN c ON v = o_orderpriority")
def m_codes(spark, sf):
    return downstream.first_seen_codes(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey", "code").select("o_orderkey", "code")


@query("m_epoch_feature", "SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds FROM orders")
def m_epoch(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", downstream.epoch_feature(F.col("o_orderdate")).alias("seconds"))


@query("m_block_label_rate", "SELECT avg((l_returnflag='R')::INT) FILTER (WHERE l_discount > 0.05) AS inside, avg((l_returnflag='R')::INT) FILTER (WHERE l_discount <= 0.05) AS outside FROM lineitem")
def m_block(spark, sf):
    return downstream.block_label_rate(table(spark, sf, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int")), F.col("l_discount") > 0.05)


@query("m_delta_vs_baseline", "SELECT * FROM (VALUES ('bank', 0.5::DOUBLE, -0.25::DOUBLE), ('ghost', 0.5::DOUBLE, NULL)) AS t(corpus, auc, delta)")
def m_delta(spark, sf):
    r = spark.createDataFrame([("bank", 0.5), ("ghost", 0.5)], "corpus string, auc double")
    return downstream.delta(r, spark.createDataFrame([("bank", 0.75)], "corpus string, auc double"), ["corpus"], "auc")


@query("m_contrast", "SELECT -0.25::DOUBLE AS block, -0.125::DOUBLE AS random, 0.0::DOUBLE AS outside, -0.125::DOUBLE AS contrast, 'the block matters' AS verdict")
def m_contrast(spark, sf):
    return downstream.contrast(spark.createDataFrame([("block", -0.25), ("random", -0.125), ("outside", 0.0)], "gate string, delta double"))


@query("m_trees", "SELECT TRUE AS learns, round_even(0.3 * count(*), 0)::BIGINT AS n FROM customer")
def m_trees(spark, sf):
    """A label that one feature tells, where that is not missing: the area under the curve of rows that were not fitted."""
    balance = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    d = table(spark, sf, "customer").withColumns({"y": (F.col("c_acctbal") > 4000).cast("int"), "balance": balance})
    parts = splitting.split(d, "c_custkey", 0.3, "test", "test")
    found = downstream.fit_trees(parts.filter("NOT test"), parts.filter("test"), ["balance", "c_nationkey"])
    return downstream.roc_auc(found).crossJoin(found.agg(F.count(F.lit(1)).alias("n"))).select((F.col("auc") > 0.85).alias("learns"), "n")


# maps cannot be compared, so the reports' inputs are literals on both sides
REPORTS = [("bank", "A2", "m1", 1, True, {"age": 0.25, "job": 0.5}, {"age": 0.125}), ("bank", "A4", "m1", 1, False, {"age": 0.75}, {"age": 0.5}), ("bank", "A2", "m1", 2, True, {"age": 0.5}, {"age": 0.25})]
_REPORT = """(VALUES ('bank','A2','m1',1,TRUE,'age',0.25::DOUBLE,0.125::DOUBLE),('bank','A2','m1',1,TRUE,'job',0.5,'nan'),('bank','A4','m1',1,FALSE,'age',0.75,0.5),('bank','A2','m1',2,TRUE,'age',0.5,0.25))
AS t(corpus, condition, model, seed, feasible, subgroup, auc_gap, representation_shift)"""


def report(spark):
    return downstream.subgroup_report(spark.createDataFrame(REPORTS, "corpus string, condition string, model string, seed int, feasible boolean, subgroup_auc_gap map<string, double>, subgroup_representation_shift map<string, double>"))


@query("m_subgroup_report", f"SELECT * REPLACE (CASE WHEN isnan(representation_shift) THEN NULL ELSE representation_shift END AS representation_shift) FROM {_REPORT}")
def m_report(spark, sf):
    return report(spark).withColumn("representation_shift", F.when(~F.isnan("representation_shift"), F.col("representation_shift")))


@query("m_subgroup_pivot", f"SELECT corpus, subgroup, round(avg(auc_gap) FILTER (WHERE condition = 'A2'), 4) AS A2, round(avg(auc_gap) FILTER (WHERE condition = 'A4'), 4) AS A4 FROM {_REPORT} WHERE feasible GROUP BY ALL")
def m_pivot(spark, sf):
    return downstream.subgroup_pivot(report(spark), "auc_gap", ["A2", "A4"])


@query("m_worst_shifts", f"SELECT corpus, subgroup AS stratum, representation_shift AS shift FROM {_REPORT} WHERE NOT isnan(representation_shift) ORDER BY shift DESC LIMIT 2")
def m_worst(spark, sf):
    shifts = report(spark).select("corpus", F.col("subgroup").alias("stratum"), F.col("representation_shift").alias("shift")).filter(~F.isnan("shift"))
    return reporting.worst_shifts(shifts, 2)


@query("m_without_leakage", "SELECT p_partkey, p_size FROM part")
def m_leakage(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", downstream.age_band(F.col("p_size")).alias("size_band"))
    return downstream.without_leakage(d, ["p_brand", "absent"])


@query("m_gated", "SELECT c_custkey FROM customer WHERE CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END >= 0")
def m_gated(spark, sf):
    return downstream.gated(table(spark, sf, "customer"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")) >= 0).select("c_custkey")


_DELTAS = f"(SELECT condition, set_retention_ex_f6 - 0.5 AS delta FROM {SCORED})"


@query("m_pooled", f"SELECT condition, avg(delta) AS mean, round(stddev_samp(delta), 9) AS sd, min(delta) AS least, max(delta) AS most, avg((delta > 0)::INT) AS share_better FROM {_DELTAS} GROUP BY condition")
def m_pooled(spark, sf):
    return downstream.pooled(scored(spark).withColumn("delta", F.col("set_retention_ex_f6") - 0.5)).withColumn("sd", F.round("sd", 9))


@query("m_interval_verdict", "SELECT * FROM (VALUES ('A2',-0.5::DOUBLE,-0.25::DOUBLE,'degrades'),('A3',0.25,0.5,'improves'),('A4',-0.5,0.5,'no effect'),('A5',NULL,NULL,'no effect')) AS t(condition, low, high, verdict)")
def m_verdict(spark, sf):
    return downstream.interval_verdict(spark.createDataFrame([("A2", -0.5, -0.25), ("A3", 0.25, 0.5), ("A4", -0.5, 0.5), ("A5", None, None)], "condition string, low double, high double"))


_TRAINED = "(VALUES ('bank','A2','m1',1,500000),('bank','A4','m2',1,0),('retail','A2','m2',1,250000),('retail','A4','ghost',9,10)) AS r(corpus, condition, model, seed, train_rows)"
_COSTED = f"""(SELECT r.*, coalesce(c.cost, 0) AS cost_usd, CASE WHEN train_rows <= 0 THEN 'inf'::DOUBLE ELSE coalesce(c.cost, 0) / (train_rows / 1e6) END AS cost_per_million
FROM {_TRAINED} LEFT JOIN (SELECT corpus, condition, model, seed, coalesce(cost_usd::DOUBLE, 0) AS cost FROM {RUNS}) c USING (corpus, condition, model, seed))"""


def trained(spark):
    rows = [("bank", "A2", "m1", 1, 500000), ("bank", "A4", "m2", 1, 0), ("retail", "A2", "m2", 1, 250000), ("retail", "A4", "ghost", 9, 10)]
    return downstream.costed(spark.createDataFrame(rows, "corpus string, condition string, model string, seed int, train_rows long"), runs(spark), ["corpus", "condition", "model", "seed"])


@query("m_costed", f"SELECT * FROM {_COSTED}")
def m_costed(spark, sf):
    return trained(spark)


@query("m_cost_pivot", f"SELECT model, round(avg(cost_usd) FILTER (WHERE condition = 'A2'), 4) AS A2, round(avg(cost_usd) FILTER (WHERE condition = 'A4'), 4) AS A4 FROM {_COSTED} GROUP BY model")
def m_cost_pivot(spark, sf):
    return downstream.cost_pivot(trained(spark), ["model"], "cost_usd", ["A2", "A4"])


@query("m_cost_totals", f"SELECT sum(cost_usd::DOUBLE) AS total_cost, avg(coalesce(output_tokens / 1000.0, 0))::DOUBLE AS mean_latency FROM {RUNS}")
def m_cost_totals(spark, sf):
    return downstream.cost_totals(runs(spark).withColumn("latency_seconds", F.col("output_tokens") / 1000))


# ---------------------------------------------------------------- documentation, facts and payloads

DICTIONARY = [("world", "r_name", "Name of the region"), ("world", "ghost", "x"), ("other", "r_regionkey", "elsewhere")]


def dictionary(spark):
    return spark.createDataFrame(DICTIONARY, "corpus string, column string, doc string")


@query("n_docs_of", "SELECT * FROM (VALUES ('r_name','Name of the region'),('ghost','x')) AS t(\"column\", doc)")
def n_docs(spark, sf):
    return census.docs_of(dictionary(spark), "world")


@query("n_attach_docs", "SELECT * FROM (VALUES ('r_regionkey',''),('r_name','Name of the region')) AS t(\"column\", doc)")
def n_attach(spark, sf):
    return census.attach_docs(spark.createDataFrame([("r_regionkey",), ("r_name",)], "column string"), census.docs_of(dictionary(spark), "world"))


def _facts(spark, sf):
    df = table(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    places = spark.createDataFrame([(c, i) for i, c in enumerate(df.columns)], "column string, place int")
    facts = census.attach_docs(census.census(df, True, True).join(F.broadcast(places), "column"), spark.createDataFrame([("c_acctbal", "Balance")], "column string, doc string"))
    return df, facts, census.top_levels(df)


@query("n_facts_record", """SELECT 'customer' AS corpus, count(*) AS row_count, 'c_nationkey,c_acctbal,c_mktsegment' AS names, 'int,float,string' AS dtypes, ',Balance,' AS docs, min(c_acctbal) AS lo, round(quantile_cont(c_acctbal, 0.5), 6) AS median,
(SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS modal, (SELECT count(*) FROM customer GROUP BY c_mktsegment ORDER BY 1 DESC LIMIT 1) AS n_modal FROM customer""")
def n_record(spark, sf):
    df, facts, levels = _facts(spark, sf)
    record = census.facts_record(facts, levels, "customer", df.count())
    c = F.col("columns")
    return record.select(
        "corpus", "row_count", *[F.array_join(c[k], ",").alias(n) for k, n in (("name", "names"), ("dtype", "dtypes"), ("doc", "docs"))], c[1]["min_value"].alias("lo"), F.round(c[1]["quantiles"]["p50"], 6).alias("median"),
        c[2]["top_levels"][0]["value"].alias("modal"), c[2]["top_levels"][0]["n"].alias("n_modal"))


@query("b_census_payload", """WITH v AS (SELECT c_mktsegment AS x, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS i FROM customer GROUP BY 1),
w AS (SELECT c_nationkey AS x, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey::VARCHAR) AS i FROM customer GROUP BY 1),
f AS (SELECT count(*) AS r, count(DISTINCT c_nationkey) AS d, min(c_nationkey) AS lo, max(c_nationkey) AS hi, quantile_cont(c_nationkey::DOUBLE, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q FROM customer)
SELECT 'Profile computed on an authoring sample of ' || format('{:,}', r) || ' rows.' || chr(10) || 'All figures below are observed counts and frequencies.' || chr(10) || chr(10)
|| '  c_nationkey (int): null 0.00%; ' || d || ' distinct; range ' || lo || ' to ' || hi || '; quantiles p01=' || printf('%g', q[1]) || ', p25=' || printf('%g', q[2]) || ', p50=' || printf('%g', q[3]) || ', p75=' || printf('%g', q[4]) || ', p99=' || printf('%g', q[5]) || chr(10)
|| '      most frequent values:' || chr(10) || (SELECT string_agg('        ' || x || ': ' || format('{:,}', n) || ' (' || printf('%.2f', 100.0 * n / r) || '%)', chr(10) ORDER BY i) FROM w WHERE i <= 15)
|| CASE WHEN d > 15 THEN chr(10) || '        ... ' || (least(d, 20) - 15) || ' further values not shown' ELSE '' END || chr(10)
|| '  c_mktsegment (string): null 0.00%; ' || (SELECT count(*) FROM v) || ' distinct' || chr(10) || '      most frequent values:' || chr(10)
|| (SELECT string_agg('        ''' || x || ''': ' || format('{:,}', n) || ' (' || printf('%.2f', 100.0 * n / r) || '%)', chr(10) ORDER BY i) FROM v WHERE i <= 15) AS payload FROM f""")
def b_census(spark, sf):
    df, facts, levels = _facts(spark, sf)
    return payload.census_lines(facts.filter("column <> 'c_acctbal'"), levels.filter("column <> 'c_acctbal'"), df.count())


@query("b_short_numbers", "SELECT * FROM (VALUES (0,'0'),(1,'1'),(2,'-1.5'),(3,'123457'),(4,'1.23457e+06'),(5,'0.0001'),(6,'1.2e-05'),(7,'1e+06'),(8,'null'),(9,'0.333333')) AS t(i, x)")
def b_numbers(spark, sf):
    values = [0.0, 1.0, -1.5, 123456.7, 1234567.0, 0.0001, 0.000012, 999999.9, None, 1 / 3]
    return spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", payload.short_number_text(F.col("v")).alias("x"))


@query("b_dictionary", "SELECT 'Table description:' || chr(10) || 'People.' || chr(10) || chr(10) || 'Column descriptions (from published documentation):' || chr(10) || '  c_acctbal: Balance' AS payload")
def b_dictionary(spark, sf):
    return payload.dictionary_lines(_facts(spark, sf)[1], "People.")


_LADDER = [("bank", "A2", "Columns: x"), ("bank", "A3", "Columns: x and docs"), ("bank", "A4", "Columns: x Profile computed on 1"), ("bank", "A5", "Columns: x Profile computed on 1 and rows"), ("taxi", "A2", "Columns: x"), ("taxi", "A3", "Columns: x"), ("taxi", "A4", "Columns: x"), ("taxi", "A5", "x")]


@query("b_ladder_checks", "SELECT * FROM (VALUES ('bank', TRUE, TRUE), ('taxi', FALSE, FALSE)) AS t(corpus, nested, all_differ)")
def b_ladder(spark, sf):
    return payload.ladder_checks(spark.createDataFrame(_LADDER, "corpus string, condition string, user string"))


@query("b_tampered", f"SELECT corpus, condition FROM {PROMPTS} WHERE condition = 'A4'")
def b_tampered(spark, sf):
    stored = spark.sql("SELECT * FROM VALUES ('bank','A2','sys','hello world'),('bank','A4','sys','hello world and more') AS t(corpus, condition, system, user)").withColumn("hash", F.sha2(F.concat_ws("\n", "system", "user"), 256))
    changed = stored.withColumn("user", F.when(F.col("condition") == "A4", "hello").otherwise(F.col("user")))
    return payload.tampered(changed).select("corpus", "condition")


@query("s_head_rows", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def s_head(spark, sf):
    return corpora.head_rows(table(spark, sf, "orders"), "o_orderkey", 100).select("o_orderkey")


# ---------------------------------------------------------------- reports, notebooks, verbs

@query("q_condition_means", f"WITH c AS (SELECT condition, avg(F2) AS mean_F2, avg(F9) AS mean_F9 FROM {SCORED} GROUP BY condition) SELECT condition, mean_F2, mean_F9, mean_F2 = min(mean_F2) OVER () AS is_best_F2, mean_F9 = min(mean_F9) OVER () AS is_best_F9 FROM c")
def q_means(spark, sf):
    return reporting.condition_means(scored(spark))


CELLS = "(SELECT corpus, condition, model, CAST(x AS DOUBLE) AS jaccard_mean FROM (VALUES ('bank','A2','claude-x',0.5),('bank','A4','claude-x',0.75),('retail','A2','gpt-y',1.0)) AS t(corpus, condition, model, x))".replace("claude-x", "alpha-x").replace("gpt-y", "beta-y")


@query("q_stability_matrix", f"SELECT corpus || ' / ' || upper(substr(model, 1, 1)) || substr(string_split(model, '-')[1], 2) AS cell, avg(CASE WHEN condition='A2' THEN jaccard_mean END) AS A2, avg(CASE WHEN condition='A4' THEN jaccard_mean END) AS A4 FROM {CELLS} GROUP BY 1")
def q_matrix(spark, sf):
    return reporting.stability_matrix(spark.sql(f"SELECT * FROM {CELLS}"), ["A2", "A4"])


RESULTS = "(SELECT corpus, condition, feasible, CAST(x AS DOUBLE) AS delta FROM (VALUES ('bank','A2',TRUE,-0.5),('bank','A4',FALSE,NULL),('retail','A2',TRUE,0.25),('retail','A2',FALSE,NULL)) AS t(corpus, condition, feasible, x))"


@query("q_planned_feasible", f"SELECT corpus, count(*) AS planned, count(*) FILTER (WHERE feasible) AS n_feasible, avg(delta) FILTER (WHERE feasible) AS mean_delta FROM {RESULTS} GROUP BY corpus")
def q_planned(spark, sf):
    return reporting.planned_feasible(spark.sql(f"SELECT * FROM {RESULTS}"))


@query("m_infeasible_matrix", f"SELECT corpus, count(*) FILTER (WHERE condition='A2') AS A2, count(*) FILTER (WHERE condition='A4') AS A4 FROM {RESULTS} WHERE NOT feasible GROUP BY corpus")
def q_infeasible(spark, sf):
    return reporting.infeasible_matrix(spark.sql(f"SELECT * FROM {RESULTS}"), ["A2", "A4"])


@query("q_lcp", "SELECT * FROM (VALUES ('bank','m1',3::BIGINT,0.5::DOUBLE,'2/3',1::BIGINT),('taxi','m1',0::BIGINT,0.0::DOUBLE,'0/1',0::BIGINT)) AS t(corpus, model, header_chars, header_share, names_recovered, rows_exact)")
def q_lcp(spark, sf):
    rows = [("bank", "m1", "abcdef", "abcxyz", "a, b,c", "b,a,z", ["1,2", "3,4"], ["0 1,2", "9"]), ("taxi", "m1", "abc", "", "q", "", ["x"], ["y"])]
    return reporting.probe_summary(spark.createDataFrame(rows, "corpus string, model string, header_truth string, header_response string, names_truth string, names_response string, rows_truth array<string>, rows_response array<string>"))


@query("q_probe_status", "SELECT * FROM (VALUES ('m1','bank','ok','failed'),('m1','taxi','-','ok')) AS t(model, corpus, header, rows)")
def q_status(spark, sf):
    rows = [("m1", "bank", "header", True, False), ("m1", "bank", "rows", False, True), ("m1", "taxi", "rows", True, False)]
    return reporting.probe_status(spark.createDataFrame(rows, "model string, corpus string, test string, done boolean, failed boolean"), ["header", "rows"])


@query("q_suspicious_tokens", "SELECT * FROM (VALUES (1, 2.0::DOUBLE, TRUE), (2, 50.0::DOUBLE, FALSE), (3, NULL, FALSE)) AS t(id, tokens_per_call, suspicious)")
def q_tokens(spark, sf):
    return reporting.suspicious_tokens(spark.createDataFrame([(1, 20, 10), (2, 500, 10), (3, 5, 0)], "id int, tokens long, calls long")).select("id", "tokens_per_call", "suspicious")


NOTEBOOK = [
    ("n1", 0, "markdown", "# Title", False), ("n1", 1, "markdown", "## A", False), ("n1", 2, "markdown", "## B", False), ("n1", 3, "code", "importlib.reload(x)", True), ("n1", 4, "code", "purge_failures(log)", True),
    ("n1", 5, "code", "load(force=True)", True), ("n1", 6, "markdown", "x" * 500, False), ("n1", 7, "code", "shutil.rmtree(p)", True), ("n1", 8, "code", "print(1)", False), ("n1", 9, "code", "print(2)", True), ("n2", 0, "code", "api_key = 'abcdefghijklmnopqrstuvwxyz'", True),
]


def cells(spark):
    return spark.createDataFrame(NOTEBOOK, "notebook string, pos int, kind string, source string, executed boolean")


@query("e_clean_cells", """SELECT * FROM (VALUES ('n1',0,'markdown',NULL),('n1',5,'code',1::BIGINT),('n1',6,'markdown',NULL),('n1',8,'code',NULL),('n1',9,'code',2::BIGINT),('n2',0,'code',1::BIGINT)) AS t(notebook, pos, kind, execution_count)""")
def e_clean(spark, sf):
    return notebooks.clean_cells(cells(spark)).select("notebook", "pos", "kind", "execution_count")


@query("e_secret_scan", "SELECT doc_id, regexp_matches(text, 'api_key\\s*=\\s*[''\"][^''\"]{20,}') AS has_key, regexp_matches(text, 'sk-[A-Za-z0-9_-]{20,}') AS has_sk FROM documents")
def e_secrets(spark, sf):
    p = dict((n, p) for p, n in notebooks.SECRETS)
    return table(spark, sf, "documents").select("doc_id", F.col("text").rlike(p["hard-coded api_key"]).alias("has_key"), F.col("text").rlike(p["API key literal"]).alias("has_sk"))


@query("e_report", "SELECT 'n1' AS notebook, 10::BIGINT AS n_cells, 5::BIGINT AS n_kept, 3::BIGINT AS n_code")
def e_report(spark, sf):
    return notebooks.report(cells(spark), notebooks.clean_cells(cells(spark)))


@query("j_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)")
def j_semi(spark, sf):
    poor = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(poor, "o_custkey", "left_semi").select("o_orderkey")


@query("j_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("j_left_default", "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def j_left(spark, sf):
    return labelled(spark, sf).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("j_inner_keys", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def j_inner(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").filter("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("j_theta_pairs", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j_theta(spark, sf):
    n = table(spark, sf, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(x), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").filter("a < b").select("a", "b")


@query("u_union_all", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def u_union(spark, sf):
    c = table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return c.unionByName(table(spark, sf, "supplier").select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


@query("o_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def o_topk(spark, sf):
    return table(spark, sf, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("v_value_frequency", "SELECT l_returnflag, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM lineitem GROUP BY 1")
def v_freq(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("v_later_duplicates", "SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS later FROM documents")
def v_later(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    firsts = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(firsts, "h").select("doc_id", (F.col("doc_id") > F.col("first")).alias("later"))


@query("v_scalars", "SELECT p_partkey, lower(trim(p_name)) AS a, replace(p_name, ' ', '_') AS b, upper(substr(p_type, 1, 3)) AS c, p_size % 7 AS d, p_size // 7 AS e, round(abs(p_retailprice), 1) AS f, regexp_extract(p_brand, '([0-9]+)', 1) AS g FROM part")
def v_scalars(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.lower(F.trim("p_name")).alias("a"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("b"), F.upper(F.substring("p_type", 1, 3)).alias("c"),
        (F.col("p_size") % 7).alias("d"), F.expr("CAST(p_size div 7 AS INT)").alias("e"), F.round(F.abs("p_retailprice"), 1).alias("f"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("g"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """A raw response, parsed, compiled, run on ``customer`` and coded."""
    return coded(spark, sf)


