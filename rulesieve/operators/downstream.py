"""Effects of gating training data: metrics, subgroups, shift, cost."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
AGE_EDGES = ((30, "<30"), (40, "30-40"), (50, "40-50"), (60, "50-60"), (200, "60+"))
LEAST_ROWS, LEAST_CLASS, LEAST_STRATUM = 500, 25, 100
ITERATIONS, STEP = 150, 0.1


def label(column: Column, value) -> Column:
    return F.coalesce((column == value).cast("int"), F.lit(0))


def age_band(age: Column) -> Column:
    """Right-closed bands; out of range or null is the text nan."""
    band = F.lit("nan")
    for edge, name in reversed(AGE_EDGES):
        band = F.when(age <= edge, name).otherwise(band)
    return F.when((age > 0) & (age <= AGE_EDGES[-1][0]), band).otherwise("nan")


def quantile_band(df: DataFrame, column: str, out: str, bins: int = 5) -> DataFrame:
    """Add ``out``: the number of the column's quantile bin, equal edges merged, null: nan."""
    edges = df.agg(F.percentile(F.col(column).cast("double"), [i / bins for i in range(bins + 1)]).alias("__edges"))
    joined = df.join(F.broadcast(edges))
    distinct = F.array_distinct("__edges")
    bin_no = F.size(F.filter(distinct, lambda e: e < F.col(column)))
    return joined.withColumn(out, F.when(F.col(column).isNull(), "nan").otherwise(F.greatest(bin_no, F.lit(1)).cast("string"))).drop("__edges")


def stratum(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("nan"))


def first_seen_codes(df: DataFrame, column: str, row_id: str, out: str) -> DataFrame:
    """Add ``out``: codes of values in order of first appearance; null is a value."""
    firsts = df.groupBy(F.col(column).alias("__value")).agg(F.min(row_id).alias("__first"))
    codes = firsts.select("__value", (F.row_number().over(Window.orderBy("__first")) - 1).cast("long").alias(out))
    return df.join(codes, F.col(column).eqNullSafe(F.col("__value")), "left").drop("__value")


def epoch_feature(column: Column) -> Column:
    return F.unix_timestamp(column.cast("timestamp_ltz"))


def gated(train: DataFrame, passes: Column) -> DataFrame:
    return train.filter(F.coalesce(passes, F.lit(False)))


def without_leakage(df: DataFrame, named: list[str]) -> DataFrame:
    """Without the named columns and those whose name ends in ``_band``."""
    return df.drop(*[c for c in df.columns if c in named or c.endswith("_band")])


def subgroup_report(results: DataFrame) -> DataFrame:
    """One row per run and subgroup from the maps ``subgroup_auc_gap`` and ``subgroup_representation_shift``; a shift that is missing is NaN."""
    base = [c for c in ("corpus", "condition", "model", "seed", "feasible") if c in results.columns]
    rows = results.select(*base, F.explode("subgroup_auc_gap").alias("subgroup", "auc_gap"), F.col("subgroup_representation_shift").alias("__s"))
    return rows.withColumn("representation_shift", F.coalesce(F.try_element_at("__s", F.col("subgroup")), F.lit(float("nan")))).drop("__s")


def subgroup_pivot(report: DataFrame, value: str, conditions: list[str]) -> DataFrame:
    """Mean of a measure of feasible runs by corpus and subgroup, a column for each condition."""
    return report.filter("feasible").groupBy("corpus", "subgroup").pivot("condition", conditions).agg(F.round(F.avg(value), 4))


def pooled(deltas: DataFrame, value: str = "delta") -> DataFrame:
    """Mean, spread and extremes of a change by condition, and the share of runs that gain."""
    x = F.col(value)
    return deltas.groupBy("condition").agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg((x > 0).cast("double")).alias("share_better"),
    )


def interval_verdict(intervals: DataFrame) -> DataFrame:
    """What an interval (low, high) of a mean change says: improves, degrades or no effect."""
    return intervals.withColumn("verdict", F.when(F.col("low") > 0, "improves").when(F.col("high") < 0, "degrades").otherwise("no effect"))


def costed(results: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Results with the cost of the run that wrote their rules (none: 0) and the cost per million rows that stay."""
    costs = log.groupBy(*key).agg(F.max(F.coalesce("cost_usd", F.lit(0.0))).alias("cost_usd"))
    joined = results.join(costs, key, "left").withColumn("cost_usd", F.coalesce("cost_usd", F.lit(0.0)))
    return joined.withColumn("cost_per_million", cost_per_million(F.col("cost_usd"), F.col("train_rows")))


def cost_pivot(results: DataFrame, by: list[str], value: str, conditions: list[str], places: int = 4) -> DataFrame:
    return results.groupBy(*by).pivot("condition", conditions).agg(F.round(F.avg(value), places))


def cost_totals(log: DataFrame) -> DataFrame:
    """What all runs cost, and how long one took on average; missing figures count as 0."""
    return log.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"), F.avg(F.coalesce("latency_seconds", F.lit(0.0))).alias("mean_latency"))


def feasibility(train: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Whether a gated training set can be fitted, and why not."""
    n, pos = F.count(F.lit(1)), F.sum(F.col(y))
    row = train.groupBy(*by).agg(n.cast("long").alias("n"), F.coalesce(pos, F.lit(0)).cast("long").alias("positives"))
    neg = F.col("n") - F.col("positives")
    reason = (
        F.when(F.col("n") < LEAST_ROWS, "too few rows")
        .when((F.col("positives") == 0) | (neg == 0), "one class")
        .when((F.col("positives") < LEAST_CLASS) | (neg < LEAST_CLASS), "too few of a class")
        .otherwise("")
    )
    return row.withColumn("reason", reason).withColumn("feasible", F.col("reason") == "")


def _score_counts(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """Positives and negatives of each distinct score: all rank metrics need no more."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(y)).alias("p"), F.sum(1 - F.col(y)).alias("q"))


#: Score ranges in which a running count is kept before the ranges are added up.
RANGES = 1024


def _running(counts: DataFrame, by: list[str]) -> DataFrame:
    """Add ``below_p`` and ``below_q``: positives and negatives with a smaller score.

    Scores are dealt to ``RANGES`` equal ranges between the least and the greatest;
    counts run inside a range and over the ranges' sums, so no task holds all
    distinct scores unless they crowd in one range.
    """
    ends = counts.groupBy(*by).agg(F.min("s").alias("__lo"), F.max("s").alias("__hi"))
    on = reduce(and_, [F.col(f"c.{c}").eqNullSafe(F.col(f"e.{c}")) for c in by], F.lit(True))
    range_no = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("s") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * RANGES)).otherwise(0)
    placed = counts.alias("c").join(F.broadcast(ends).alias("e") if not by else ends.alias("e"), on).select("c.*", range_no.alias("__r"))
    sums = placed.groupBy(*by, "__r").agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    earlier = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__r", *[F.coalesce(F.sum(f"__{k}").over(earlier), F.lit(0)).alias(f"__before_{k}") for k in "pq"])
    inside = Window.partitionBy(*by, "__r").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.select("*", *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"__in_{k}") for k in "pq"])
    both = reduce(and_, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "__r"]])
    joined = ranked.alias("a").join(F.broadcast(offsets).alias("b") if not by else offsets.alias("b"), both)
    return joined.select("a.*", *[(F.col(f"__in_{k}") + F.col(f"__before_{k}")).alias(f"below_{k}") for k in "pq"])


def roc_auc(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """Exact area under the ROC curve, ties counted half: ``by, auc``; null without both classes.

    Rows are first combined by score; counts then run over distinct scores.
    """
    by = by or []
    counts = _running(_score_counts(df, by, score, y), by)
    wins = F.col("p") * (F.col("below_q") + F.col("q") / 2)
    return counts.withColumn("w", wins).groupBy(*by).agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def average_precision(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    """Step-wise average precision over distinct scores, descending."""
    by = by or []
    counts = _running(_score_counts(df, by, score, y), by)
    totals = counts.groupBy(*by).agg(F.sum("p").alias("__tp"), F.sum("q").alias("__tq"))
    on = reduce(and_, [F.col(f"c.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by], F.lit(True))
    joined = counts.alias("c").join(F.broadcast(totals).alias("t") if not by else totals.alias("t"), on).select("c.*", "__tp", "__tq")
    above_p, above_q = F.col("__tp") - F.col("below_p"), F.col("__tq") - F.col("below_q")
    return joined.withColumn("w", F.col("p") * above_p / (above_p + above_q)).groupBy(*by).agg((F.sum("w") / F.nullif(F.sum("p"), F.lit(0))).alias("average_precision"))


def brier(df: DataFrame, by: list[str] | None = None, score: str = "score", y: str = "y") -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(score) - F.col(y), 2)).alias("brier"))


def subgroup_auc(df: DataFrame, level: str, score: str = "score", y: str = "y", least: int = LEAST_STRATUM) -> DataFrame:
    """AUC of each level with enough rows and both classes."""
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).filter((F.col("n") >= least) & (F.col("p") > 0) & (F.col("p") < F.col("n")))
    return roc_auc(df, [level], score, y).join(counts.select(level, "n"), level)


def subgroup_gap(levels: DataFrame) -> DataFrame:
    """Largest minus smallest AUC; null with fewer than two levels."""
    return levels.agg(F.when(F.count(F.lit(1)) >= 2, F.max("auc") - F.min("auc")).alias("gap"))


def composition_shift(before: DataFrame, after: DataFrame, level: str) -> DataFrame:
    """Half the summed change of level shares, over the levels before."""
    share = lambda d, name: d.groupBy(level).agg(F.count(F.lit(1)).alias("c")).withColumn(name, F.col("c") / F.sum("c").over(Window.partitionBy())).drop("c")
    joined = share(before, "b").join(share(after, "a"), level, "left")
    return joined.agg((F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.col("b"))) / 2).alias("shift"))


def delta(results: DataFrame, baseline: DataFrame, on: list[str], metric: str) -> DataFrame:
    base = baseline.select(*on, F.col(metric).alias("__base"))
    return results.join(F.broadcast(base), on, "left").withColumn("delta", F.col(metric) - F.col("__base")).drop("__base")


def block_label_rate(df: DataFrame, block: Column, y: str = "y") -> DataFrame:
    inside = F.coalesce(block, F.lit(False))
    return df.agg(F.avg(F.when(inside, F.col(y))).alias("inside"), F.avg(F.when(~inside, F.col(y))).alias("outside"))


def contrast(deltas: DataFrame) -> DataFrame:
    """Change by removing the block against removing as many at random."""
    row = deltas.agg(*[F.avg(F.when(F.col("gate") == g, F.col("delta"))).alias(g) for g in ("block", "random", "outside")])
    gap = F.col("block") - F.col("random")
    verdict = F.when(gap < -0.05, "the block matters").when(gap > -0.01, "size alone explains it").otherwise("unclear")
    return row.withColumn("contrast", gap).withColumn("verdict", verdict)


def cost_per_million(cost: Column, rows: Column) -> Column:
    return F.when(rows <= 0, F.lit(float("inf"))).otherwise(cost / (rows / 1e6))


def fit_trees(train: DataFrame, test: DataFrame, features: list[str], y: str = "y", iterations: int = ITERATIONS, seed: int = 1) -> DataFrame:
    """Boosted trees on the gated rows; ``test`` with ``score``.

    Missing features become their own indicator and -1.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    def prepared(d: DataFrame) -> DataFrame:
        for f in features:
            d = d.withColumn(f"__m_{f}", F.col(f).isNull().cast("double")).withColumn(f"__x_{f}", F.coalesce(F.col(f).cast("double"), F.lit(-1.0)))
        return VectorAssembler(inputCols=[f"__{k}_{f}" for f in features for k in "xm"], outputCol="__features").transform(d)

    model = GBTClassifier(featuresCol="__features", labelCol=y, maxIter=iterations, stepSize=STEP, seed=seed).fit(prepared(train))
    scored = model.transform(prepared(test))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*test.columns, "score")
