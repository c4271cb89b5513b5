"""Retention of rules and rule sets, all rules of a table in one pass."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import NotExecutable, Rule, canonical, mask, with_unique_counts

#: Counts in one aggregate; the compiler of the JVM leaves wider ones' methods interpreted.
CHUNK = 64


@dataclass(frozen=True)
class Placed:
    """A rule with its place: set, position, whether it can run, whether it is F6."""

    set_id: str
    pos: int
    rule: Rule
    executable: bool = True
    mismatch: bool = False


def compiled(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, dict[str, Column]]:
    """The table with what masks need, and a mask for each distinct rule that runs."""
    distinct = {canonical(r): r for r in rules if r.column in df.columns and r.predicate}
    wide = with_unique_counts(df, list(distinct.values()))
    masks = {}
    for key, rule in distinct.items():
        try:
            masks[key] = mask(wide, rule)
        except NotExecutable:
            continue
    return wide, masks


def counted(df: DataFrame, tests: list[Column]) -> list[DataFrame]:
    """For each chunk of tests one row: ``rows``, and the counts ``n0, n1, ...`` of rows that pass."""
    chunks = [tests[i : i + CHUNK] for i in range(0, len(tests), CHUNK)]
    return [df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(t).alias(f"n{j}") for j, t in enumerate(some)]) for some in chunks]


def unpivoted(df: DataFrame, tests: list[Column]) -> DataFrame:
    """``i, n, rows``: for each test how many of how many rows pass; one pass over the table a chunk of tests."""
    parts = []
    for k, row in enumerate(counted(df, tests)):
        counts = F.array(*[f"n{j}" for j in range(min(CHUNK, len(tests) - k * CHUNK))])
        cells = row.select("rows", F.posexplode(counts).alias("j", "n"))
        parts.append(cells.select((F.col("j") + k * CHUNK).alias("i"), "n", "rows"))
    return reduce(DataFrame.unionByName, parts)


def _share() -> Column:
    return F.col("n") / F.nullif("rows", F.lit(0))


def rule_retention(df: DataFrame, rules: list[Rule]) -> dict[str, float]:
    """Share of rows that pass, by canonical rule; one aggregate job a chunk."""
    wide, masks = compiled(df, rules)
    if not masks:
        return {}
    keys = list(masks)
    return {keys[r["i"]]: r["share"] for r in unpivoted(wide, list(masks.values())).select("i", _share().alias("share")).collect()}


def _labelled(counts: DataFrame, labels: list[tuple], fields: str) -> DataFrame:
    """``counts`` with the fields that a list has for each ``i``; lists are as long as rule sets."""
    return counts.join(F.broadcast(counts.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(labels)], f"i int, {fields}")), "i").drop("i")


def retention_frame(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rule_id, retention`` of rules that run, lazily; equal rules are evaluated once."""
    wide, masks = compiled(df, rules)
    kept = [r for r in rules if canonical(r) in masks]
    if not kept:
        return df.sparkSession.createDataFrame([], "rule_id string, retention double")
    place = {k: i for i, k in enumerate(masks)}
    ids = df.sparkSession.createDataFrame([(place[canonical(r)], r.rule_id) for r in kept], "i int, rule_id string")
    return unpivoted(wide, list(masks.values())).join(F.broadcast(ids), "i").select("rule_id", _share().alias("retention"))


def set_retention(df: DataFrame, placed: list[Placed]) -> DataFrame:
    """``set_id, set_retention, set_retention_ex_f6, n_f6``; one pass a chunk of sets.

    A set without rules that run keeps every row.  Sets with the same rules are
    evaluated once, and those without type mismatches too.
    """
    wide, masks = compiled(df, [p.rule for p in placed if p.executable])
    sets: dict[str, list[Placed]] = {}
    for p in placed:
        sets.setdefault(p.set_id, [])
        if p.executable and canonical(p.rule) in masks:
            sets[p.set_id].append(p)
    tests: dict[frozenset, int] = {}
    labels = []
    for set_id, own in sets.items():
        every, plain = (frozenset(canonical(p.rule) for p in own if all_of or not p.mismatch) for all_of in (True, False))
        labels.append((set_id, tests.setdefault(every, len(tests)), tests.setdefault(plain, len(tests)), sum(p.mismatch for p in own)))
    if not labels:
        return df.sparkSession.createDataFrame([], "set_id string, set_retention double, set_retention_ex_f6 double, n_f6 long")
    passes = [reduce(and_, [masks[k] for k in sorted(keys)], F.lit(True)) for keys in tests]
    shares = unpivoted(wide, passes).select("i", _share().alias("share"))
    named = df.sparkSession.createDataFrame(labels, "set_id string, a int, b int, n_f6 long")
    ends = named.select("set_id", "n_f6", F.explode(F.array(F.struct(F.lit(True).alias("whole"), F.col("a").alias("i")), F.struct(F.lit(False).alias("whole"), F.col("b").alias("i")))).alias("x")).select("set_id", "n_f6", "x.*")
    both = shares.join(F.broadcast(ends), "i").groupBy("set_id", "n_f6")
    pick = lambda whole: F.max(F.when(F.col("whole") == whole, F.col("share")))
    return both.agg(pick(True).alias("set_retention"), pick(False).alias("set_retention_ex_f6")).select("set_id", "set_retention", "set_retention_ex_f6", "n_f6")


def inert_rate(rules: DataFrame) -> DataFrame:
    """By ``set_id``: share of executable rules with a retention of at least 1; none: 0."""
    kept = F.when(F.col("executable") & F.col("retention").isNotNull(), (F.col("retention") >= 1).cast("double"))
    return rules.groupBy("set_id").agg(F.coalesce(F.avg(kept), F.lit(0.0)).alias("inert_rate"))


def retention_product(rules: DataFrame) -> DataFrame:
    """By ``set_id``: product of its rules' retentions, none: 1."""
    return rules.groupBy("set_id").agg(F.coalesce(F.product("retention"), F.lit(1.0)).alias("product"))


def independence(sets: DataFrame) -> DataFrame:
    """Set retention over the product of its rules' retentions; null at product 0."""
    return sets.withColumn("independence_ratio", F.col("set_retention") / F.nullif("product", F.lit(0.0)))


def mismatch_gap(scored: DataFrame) -> DataFrame:
    gap = F.col("set_retention_ex_f6") - F.col("set_retention")
    return scored.groupBy("corpus", "condition").agg(
        F.avg(gap).alias("mean_gap"), F.count_if(F.col("set_retention") == 0).alias("zero_with"), F.count_if(F.col("set_retention_ex_f6") == 0).alias("zero_without")
    )


def summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("corpus", "condition", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg("set_retention").alias("mean_retention"), F.stddev_samp("set_retention").alias("sd_retention"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("F9", "F4", "F2")],
    )


def ladder(scored: DataFrame, conditions: list[str], value: str = "set_retention") -> DataFrame:
    """Mean by corpus and model, a column for each condition."""
    return scored.groupBy("corpus", "model").pivot("condition", conditions).agg(F.avg(value))


def collapsed(scored: DataFrame, rules: DataFrame, below: float = 0.99) -> DataFrame:
    """Rules under ``below`` of the first zero-retention set of each cell."""
    from pyspark.sql import Window

    first = Window.partitionBy("corpus", "condition", "model").orderBy("seed", "set_id")
    zero = scored.filter("set_retention = 0").withColumn("__i", F.row_number().over(first)).filter("__i = 1")
    return zero.select("corpus", "condition", "model", "set_id").join(rules.filter(F.col("retention") < below).select("set_id", "rule_id", "retention"), "set_id")


def block_attribution(df: DataFrame, rules: list[Rule], block: Column, pure: float = 0.95) -> DataFrame:
    """What each rule rejects of a block of rows; one pass a chunk of rules."""
    wide, masks = compiled(df.withColumn("__block", F.coalesce(block, F.lit(False))), rules)
    kept = [r for r in {canonical(r): r for r in rules}.values() if canonical(r) in masks]
    tests = [t for r in kept for t in (F.col("__block"), ~masks[canonical(r)], ~masks[canonical(r)] & F.col("__block"))]
    if not kept:
        return df.sparkSession.createDataFrame([], "rule_id string, rejected long, block_removed double, inside_block double, pure boolean")
    counts = _labelled(unpivoted(wide, tests), [(r.rule_id, k) for r in kept for k in ("block", "rejected", "in_block")], "rule_id string, what string")
    pick = lambda k: F.max(F.when(F.col("what") == k, F.col("n"))).alias(k)
    rows = counts.groupBy("rule_id").agg(pick("rejected"), pick("in_block"), pick("block")).filter("rejected > 0")
    share, inside = F.col("in_block") / F.nullif("block", F.lit(0)), F.col("in_block") / F.col("rejected")
    return rows.select("rule_id", "rejected", share.alias("block_removed"), inside.alias("inside_block"), ((share > pure) & (inside > pure)).alias("pure"))


def block_against_delta(gates: DataFrame, deltas: DataFrame) -> DataFrame:
    """Block removed by each gate, joined with its change; correlation and means."""
    joined = gates.join(deltas, ["condition", "model", "seed"], "inner")
    high = F.col("block_removed") > 0.5
    return joined.agg(
        F.corr("block_removed", "delta").alias("r"), F.avg(F.when(high, F.col("delta"))).alias("mean_above"),
        F.avg(F.when(~high, F.col("delta"))).alias("mean_below"), F.count(F.lit(1)).alias("n"),
    )


def mask_patterns(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Histogram of pass patterns (a '1' or '0' a rule): what overlaps are computed from."""
    wide, masks = compiled(df, rules)
    bits = F.concat(*[F.when(masks[canonical(r)], "1").otherwise("0") for r in rules])
    return wide.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def rejected_overlap(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Jaccard similarity of what each pair of rules rejects, from the histogram."""
    patterns = mask_patterns(df, rules)
    out = None
    fails = lambda i: F.substring("pattern", i + 1, 1) == "0"
    parts, pairs = [], []
    for i in range(len(rules)):
        for j in range(i + 1, len(rules)):
            parts += [
                F.sum(F.when(fails(i) & fails(j), F.col("n")).otherwise(0)).alias(f"b{i}_{j}"),
                F.sum(F.when(fails(i) | fails(j), F.col("n")).otherwise(0)).alias(f"e{i}_{j}"),
            ]
            pairs.append((i, j))
    row = patterns.agg(*parts)
    out = F.array(*[
        F.struct(
            F.lit(rules[i].rule_id).alias("rule_a"), F.lit(rules[j].rule_id).alias("rule_b"),
            F.when(F.col(f"e{i}_{j}") > 0, F.col(f"b{i}_{j}") / F.col(f"e{i}_{j}")).otherwise(1.0).alias("jaccard"),
        )
        for i, j in pairs
    ])
    return row.select(F.inline(out))


def coincidence(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Whether conditions hold on exactly the same rows: one aggregate."""
    tests = [F.coalesce(c, F.lit(False)) for c in conditions.values()]
    both, either = reduce(and_, tests), reduce(lambda a, b: a | b, tests)
    counts = [F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests)]
    row = df.agg(F.count_if(both).alias("intersection"), F.count_if(either).alias("union"), *counts)
    equal = reduce(and_, [F.col(f"n{i}") == F.col("union") for i in range(len(tests))])
    return row.select("intersection", "union", (F.col("intersection") / F.nullif("union", F.lit(0))).alias("jaccard"), equal.alias("all_equal"))
