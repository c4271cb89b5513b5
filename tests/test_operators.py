import ast
import json
import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rulesieve.functions.rules import Rule
from rulesieve.operators import census, notebooks, payload, runlog, splitting
from rulesieve.sources import corpora
from rulesieve.streaming import gate

ROOT = pathlib.Path(__file__).resolve().parents[1] / "rulesieve"


def imports(path):
    tree = ast.parse(path.read_text())
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            yield from ([f"{node.module or ''}"] + [a.name for a in node.names])
        elif isinstance(node, ast.Import):
            yield from (a.name for a in node.names)


def test_authoring_never_imports_evaluation():
    evaluation = {"taxonomy", "retention", "downstream", "similarity"}
    for name in ("census", "splitting", "payload"):
        assert not evaluation & {part for i in imports(ROOT / "operators" / f"{name}.py") for part in i.split(".")}


def test_nothing_imports_the_corpus_operators():
    for path in ROOT.rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any("llm" in i.split(".") for i in imports(path)), path


def test_cells(spark):
    """Against the plain stack walk."""
    import random

    rng = random.Random(4)
    kinds = {"d": ("code", "importlib.reload(x)"), "s": ("markdown", "# s"), "l": ("markdown", "x" * 500), "c": ("code", "print()")}
    books = {f"n{i}": [rng.choice("ddsslc") for _ in range(rng.randint(1, 14))] for i in range(40)}
    rows = [(n, p, *kinds[k], True) for n, ks in books.items() for p, k in enumerate(ks)]
    got = {}
    for r in notebooks.clean_cells(spark.createDataFrame(rows, "notebook string, pos int, kind string, source string, executed boolean")).collect():
        got.setdefault(r["notebook"], []).append(r["pos"])
    for n, ks in books.items():
        kept = []
        for p, k in enumerate(ks):
            if k != "d":
                kept.append((p, k))
            elif kept and kept[-1][1] == "s":
                kept.pop()
        assert sorted(got.get(n, [])) == [p for p, _ in kept]


def test_split_is_a_partition(spark):
    df = spark.range(1003).withColumnRenamed("id", "row")
    parts = splitting.split(df, "row", 0.2)
    assert parts.filter("authoring").count() == 201 and parts.count() == 1003
    assert {r[0] for r in splitting.split(df, "row", 0.2).filter("authoring").select("row").collect()} == {r[0] for r in parts.filter("authoring").select("row").collect()}
    assert splitting.split(df.limit(0), "row").count() == 0


def test_bootstrap():
    mean, low, high = splitting.bootstrap_ci([1.0, 2.0, 3.0, float("nan")], 500)
    assert low <= mean == 2.0 <= high
    assert all(x != x for x in splitting.bootstrap_ci([]))


def test_payload_ladder(spark):
    facts = spark.createDataFrame([(0, "a", "int", 0.0, 18, 1.0, 2.0, "The a."), (1, "it's", "string", 0.25, 3, None, None, " ")], "place int, column string, logical_type string, null_rate double, distinct_count long, min_value double, max_value double, doc string")
    facts = facts.withColumns({q: F.lit(None).cast("double") for q in ("q01", "q25", "q50", "q75", "q99")})
    levels = spark.createDataFrame([("a", str(i), 1900 - i, i + 1) for i in range(18)] + [("it's", "it's", 2, 1)], "column string, value string, n long, place long")
    text = payload.census_lines(facts, levels, 1000).first()[0]
    assert text.split("\n")[3] == "  a (int): null 0.00%; 18 distinct; range 1 to 2" and "        0: 1,900 (190.00%)\n" in text and "        ... 3 further values not shown\n  it's (string): null 25.00%; 3 distinct\n" in text
    assert text.endswith('        "it\'s": 2 (0.20%)')
    docs = payload.dictionary_lines(facts).first()[0]
    assert docs == "Column descriptions (from published documentation):\n  a: The a." and payload.dictionary_lines(facts.limit(0)).first()[0] == ""
    parts = dict(schema="Table: t", task="Write rules.", dictionary=docs, census=text, samples=payload.samples_block(['{"a": 1}']))
    a2, a4, a5 = (payload.assemble(c, **parts) for c in ("A2", "A4", "A5"))
    assert len(a2) < len(a4) < len(a5) and len({payload.bundle_hash("s", x) for x in (a2, a4, a5)}) == 3
    with pytest.raises(Exception, match="interpretive"):
        payload.census_lines(facts.withColumn("column", F.lit("sentinel")), levels, 1000).collect()
    with pytest.raises(payload.LeakageError):
        payload.guard("this is a Sentinel")
    for bad in (dict(condition="A9"), dict(condition="A3"), dict(condition="A5")):
        with pytest.raises(ValueError):
            payload.assemble(schema="s", task="t", **bad)


def test_facts_survive_a_file(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    facts = census.attach_docs(census.census(df).join(spark.createDataFrame([("a", 0), ("b", 1)], "column string, place int"), "column"), spark.createDataFrame([("a", "d")], "column string, doc string"))
    record = census.facts_record(facts, census.top_levels(df), "c", 2, "T")
    digest = census.save_facts(record, str(tmp_path / "f"))
    loaded = census.load_facts(spark, str(tmp_path / "f"))
    assert loaded.first()["content_sha256"] == digest and loaded.drop("content_sha256").first() == record.first()
    (tmp_path / "g").write_text('{"corpus":"c","row_count":1,"columns":[{"name":"a","dtype":"int"}]}')
    old = census.load_facts(spark, str(tmp_path / "g")).first()
    assert old["table_doc"] == "" and old["columns"][0]["doc"] == "" and old["columns"][0]["top_levels"] == []


def test_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "i int, t string")
    for kind in ("csv", "json", "jsonl", "parquet"):
        for _ in range(2):  # the second replaces the first
            corpora.save_artifact(df, str(tmp_path / kind), kind)
        got = corpora.load_artifact(spark, str(tmp_path / kind), kind, None if kind == "parquet" else "i int, t string")
        assert [tuple(r) for r in got.orderBy("i").collect()] == [(1, "a"), (2, None), (3, "")], kind
    corpora.save_artifact(df.select("t").na.drop(), str(tmp_path / "text"), "text")
    assert corpora.load_artifact(spark, str(tmp_path / "text"), "text").count() == 2
    assert not list(tmp_path.glob("*.tmp"))
    for call in (lambda: corpora.save_artifact(df, str(tmp_path / "x"), "pickle"), lambda: corpora.load_artifact(spark, str(tmp_path / "csv"), "csv")):
        with pytest.raises(ValueError):
            call()


def test_notebooks_are_written_back(spark, tmp_path):
    cells = spark.createDataFrame([("n", 1, "code", "a = 1\nb = 2", 7), ("n", 0, "markdown", "# T", None), ("m", 0, "code", "x", None)], "notebook string, pos int, kind string, source string, execution_count long")
    corpora.write_notebooks(cells, str(tmp_path / "out"))
    book = json.loads(next((tmp_path / "out" / "notebook=n").glob("part-*")).read_text())
    assert [c["cell_type"] for c in book["cells"]] == ["markdown", "code"] and book["cells"][1]["source"] == ["a = 1\n", "b = 2"] and book["cells"][1]["execution_count"] == 7 and book["nbformat"] == 4
    again = {(r["kind"], r["source"], r["executed"]) for r in corpora.read_notebooks(spark, str(tmp_path / "out" / "*" / "part-*")).collect()}
    assert again == {("code", "a = 1\nb = 2", True), ("markdown", "# T", False), ("code", "x", False)}


def test_exact_quantiles_hold_few_values(spark, monkeypatch):
    """Only values near a quantile are counted one by one, and a sketch that is far off costs time, not exactness."""
    n = 100_000
    modal = F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 1000 == 1, float("nan")).otherwise(F.col("id") / 8)
    df = spark.range(n, numPartitions=4).select(((F.col("id") * 7919) % n).alias("key"), modal.alias("modal"), ((F.col("id") % 2 - 1).cast("double") * 0.0).alias("zeros"), F.col("id").cast("string").alias("text"))
    near, counted = [], census._near_counts
    monkeypatch.setattr(census, "_near_counts", lambda *a: near.append(counted(*a)) or near[-1])
    values = df.toPandas()
    wanted = {c: np.quantile(values[c].astype(float).dropna(), census.QUANTILES) for c in df.columns}
    for margins in (census.MARGINS, (0.0,)):
        monkeypatch.setattr(census, "MARGINS", margins)
        got = {r["column"]: r for r in census.census(df, True, True).collect()}
        for c, w in wanted.items():
            assert [got[c][f"q{round(q * 100):02d}"] for q in census.QUANTILES] == pytest.approx(list(w)), (margins, c)
        assert [got[c]["distinct_count"] for c in df.columns] == [n, values["modal"].nunique(), 2, n]
        if margins != (0.0,):
            assert near and max(x.count() for x in near) < n / 100


def test_census_of_mixed_columns(spark):
    df = spark.createDataFrame([("1", 1.5, None), ("2", float("nan"), None), ("x", None, None)], "t string, f double, e string")
    got = {r["column"]: r for r in census.census(df, True, True).collect()}
    assert (got["t"]["logical_type"], got["f"]["logical_type"], got["e"]["logical_type"]) == ("string", "float", "string")
    assert got["f"]["null_rate"] == pytest.approx(2 / 3) and got["e"]["distinct_count"] == 0 and got["t"]["distinct_count"] == 3
    rough = {r["column"]: r["distinct_count"] for r in census.census(df).collect()}
    assert rough["t"] == 3


def test_csv_keeps_every_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a;b;c\nNA;;1\n"";null;2\n')
    rows = corpora.read_csv(spark, str(tmp_path / "a.csv"), "a string, b string, c int", sep=";").collect()
    assert [tuple(r) for r in rows] == [("NA", "", 1), ("", "null", 2)]


def test_log_skips_damage(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"corpus": "a", "ok": true}\n\n{"corpus": "b", "o')
    assert [r["corpus"] for r in corpora.read_log(spark, str(path), "corpus string, ok boolean").collect()] == ["a"]


def test_log_grows_once_a_key(spark, tmp_path):
    path = str(tmp_path / "log")
    for rows in ([("a", 1, True)], [("a", 1, False), ("a", 2, True)], [("a", 2, True), ("a", 2, True)]):
        corpora.append_log(spark.createDataFrame(rows, "corpus string, seed long, ok boolean"), path, ["corpus", "seed"])
    got = corpora.read_log(spark, path, "corpus string, seed long, ok boolean").orderBy("seed").collect()
    assert [tuple(r) for r in got] == [("a", 1, True), ("a", 2, True)]


def test_registry(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "p"))
    reg = corpora.Registry(corpora.Corpus("p", (str(tmp_path / "p"), str(tmp_path / "p")), expected_rows=10), corpora.Corpus("q", (str(tmp_path / "none"),)), corpora.Corpus("z", (str(tmp_path / "p"),), "odd"), corpora.Corpus("w", (str(tmp_path / "p"),), expected_rows=6))
    assert reg.load(spark, "p", check_rows=True).count() == 10
    for name, error in (("absent", KeyError), ("q", FileNotFoundError), ("z", ValueError)):
        with pytest.raises(error):
            reg.load(spark, name)
    with pytest.raises(ValueError):
        reg.load(spark, "w", check_rows=True)
    assert corpora.digests(spark, str(tmp_path / "p")).count() > 0
    assert corpora.discover(spark, str(tmp_path), ".parquet", "PART").first()["path"].endswith(".parquet")
    assert corpora.assert_counts(spark.range(5), {"low": (F.col("id") < 2, 2)}).first()["low"] == 2


def test_step_cache(spark, tmp_path):
    cache, built = runlog.StepCache(spark, str(tmp_path / "cache")), []
    build = lambda: built.append(1) or spark.range(3)
    assert cache.get("a", build).count() == cache.get("a", build).count() == 3 and len(built) == 1
    cache.get("a", build, force=True)
    assert len(built) == 2 and cache.record("a")["rows"] == 3 and cache.intact("a")
    newer = runlog.StepCache(spark, str(tmp_path / "cache"), "2")
    newer.get("a", build)
    assert len(built) == 3 and newer.record("a")["version"] == "2"
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "cache" / "a"))
    assert not newer.intact("a") and cache.status(["a", "b"]) == {"a": True, "b": False}
    with pytest.raises(ValueError):
        cache.clear(["a"])
    cache.clear(["a"], confirm=True)
    assert not cache.has("a")
    with pytest.raises(ValueError):
        cache.get("../a", build)


def test_sweep_and_purge(spark, tmp_path):
    runs = spark.createDataFrame([("c", "A2", "mock", i, 0.0, "w") for i in range(4)], "corpus string, condition string, model string, seed long, temperature double, variant string")
    done = runlog.execute(runs)
    assert done.filter("ok").count() == 4 and json.loads(done.first()["raw_response"])["rules"]
    assert runlog.pending(runs, done.filter("seed < 2"), list(runlog.KEY)).count() == 2

    def broken(key):
        raise RuntimeError("no answer")

    failed = runlog.execute(runs, broken, backoff=0.0)
    assert {r["attempts"] for r in failed.collect()} == {3}
    assert failed.filter("NOT ok AND failure_reason LIKE '%no answer%'").count() == 4
    with pytest.raises(ValueError):
        runlog.purge_failures(failed, " ", str(tmp_path / "p"))
    paths = runlog.purge_failures(done.unionByName(failed), "test", str(tmp_path / "p"))
    assert spark.read.parquet(paths["archived"]).count() == 4


def test_attempts_wait_longer_each_time(monkeypatch):
    class AuthenticationError(Exception):
        pass

    waits, calls = [], []
    monkeypatch.setattr(runlog.time, "sleep", waits.append)

    def flaky(key):
        calls.append(key)
        return " " if len(calls) < 3 else "text"

    def refused(key):
        raise AuthenticationError("no")

    assert runlog.attempted(flaky, "k", 3, 2.0) == ("text", 3, None) and waits == [2.0, 4.0]
    assert runlog.attempted(refused, "k", 3, 2.0) == (None, 1, "AuthenticationError: no") and len(waits) == 2


def test_rank_metrics_over_many_ranges(spark):
    """Against a count of all pairs, with ties, one score only and null groups."""
    import random

    from rulesieve.operators import downstream

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0.0, 0.5, 1e9, rng.random()]), rng.randint(0, 1)) for _ in range(400)] + [("c", 0.25, 1), ("c", 0.25, 0), ("d", 1.0, 1)]
    df = spark.createDataFrame(rows, "g string, score double, y int")

    def auc(some):
        wins = [(p > q) + (p == q) / 2 for _, p, a in some if a for _, q, b in some if not b]
        return sum(wins) / len(wins) if wins else None

    def precision(some):
        total = sum(y for _, _, y in some)
        return sum(y * sum(b for _, t, b in some if t >= s) / sum(t >= s for _, t, _ in some) for _, s, y in some) / total

    of = lambda g: [r for r in rows if r[0] == g]
    got = {r["g"]: r["auc"] for r in downstream.roc_auc(df, ["g"]).collect()}
    assert got == {g: pytest.approx(auc(of(g))) if g != "d" else None for g in ("a", "b", "c", "d", None)}
    assert downstream.roc_auc(df).first()["auc"] == pytest.approx(auc(rows))
    got = {r["g"]: r["average_precision"] for r in downstream.average_precision(df, ["g"]).collect()}
    assert got == {g: pytest.approx(precision(of(g))) for g in ("a", "b", "c", "d", None)}
    assert downstream.average_precision(df).first()["average_precision"] == pytest.approx(precision(rows))


def test_streaming_gate(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rules = [Rule("value", "range", {"min": 50}, "v"), Rule("event_type", "not_null", {}, "w", "warn")]
    q = gate.windowed_retention(stream.withColumn("ts", F.col("ts").cast("timestamp")), rules, "ts").writeStream.format("memory").queryName("kept").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    whole = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count(F.lit(1)), F.count_if(F.col("value") >= 50)).first()
    got = spark.table("kept").agg(F.sum("n"), F.sum(F.col("n") * F.col("retention"))).first()
    assert got[0] == whole[0] and got[1] == pytest.approx(whole[1])
    with pytest.raises(ValueError):
        gate.gate(stream, [Rule("value", "unique")])


def test_m_trees_fits_all_rounds(spark, sf_dir, monkeypatch):
    import inspect

    from rulesieve.operators import downstream
    from rulesieve.plans import catalogue

    asked = []
    signature = inspect.signature(downstream.fit_trees)

    def fit(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        asked.append(bound.arguments["iterations"])
        return bound.arguments["test"].withColumn("score", F.rand(1))

    monkeypatch.setattr(downstream, "fit_trees", fit)
    catalogue.m_trees(spark, sf_dir).collect()
    assert asked == [150]


def test_rule_sets_start_python_on_one_row_only(spark, sf_dir, monkeypatch):
    """Neither the response nor the rules are dealt over all cores, each of which would start Python for its part."""
    from rulesieve.plans import catalogue

    parsed, parse = [], catalogue.parsing.parse_rulesets
    monkeypatch.setattr(catalogue.parsing, "parse_rulesets", lambda df, *a: parsed.append(df) or parse(df, *a))
    found = catalogue.coded(spark, sf_dir)
    for df in (*parsed, found):
        assert "ExistingRDD" not in df._jdf.queryExecution().toString()
    assert len(parsed) == 1 and parsed[0].rdd.getNumPartitions() == 1
