"""Datasets behind reports: condition means, stability matrix, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import common_prefix_length


def condition_means(scored: DataFrame, codes: tuple[str, ...] = ("F2", "F9")) -> DataFrame:
    """Mean of each code by condition, and whether it is the least."""
    out = scored.groupBy("condition").agg(*[F.avg(c).alias(f"mean_{c}") for c in codes])
    best = out.agg(*[F.min_by("condition", f"mean_{c}").alias(f"best_{c}") for c in codes])
    joined = out.join(F.broadcast(best))
    return joined.select("condition", *[f"mean_{c}" for c in codes], *[(F.col("condition") == F.col(f"best_{c}")).alias(f"is_best_{c}") for c in codes])


def short_model(model: Column) -> Column:
    return F.initcap(F.split(model, "[-/]")[0])


def stability_matrix(cells: DataFrame, conditions: list[str]) -> DataFrame:
    named = cells.withColumn("cell", F.concat_ws(" / ", "corpus", short_model(F.col("model"))))
    return named.groupBy("cell").pivot("condition", conditions).agg(F.avg("jaccard_mean"))


def planned_feasible(results: DataFrame) -> DataFrame:
    return results.groupBy("corpus").agg(F.count(F.lit(1)).alias("planned"), F.count_if("feasible").alias("n_feasible"), F.avg(F.when(F.col("feasible"), F.col("delta"))).alias("mean_delta"))


def infeasible_matrix(results: DataFrame, conditions: list[str]) -> DataFrame:
    return results.filter("NOT feasible").groupBy("corpus").pivot("condition", conditions).count().na.fill(0)


def worst_shifts(shifts: DataFrame, n: int = 10) -> DataFrame:
    return shifts.orderBy(F.col("shift").desc(), "corpus", "stratum").limit(n)


def probe_summary(probes: DataFrame) -> DataFrame:
    """Of (truth, response) headers, feature lists and rows: what was reproduced."""
    parts = lambda c: F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    names = parts(F.col("names_truth"))
    known = F.size(F.filter(names, lambda x: F.array_contains(parts(F.col("names_response")), x)))
    pairs = F.arrays_zip(F.col("rows_truth").alias("t"), F.col("rows_response").alias("r"))
    exact = F.size(F.filter(pairs, lambda p: (F.trim(p["t"]) != "") & F.contains(F.trim(p["r"]), F.trim(p["t"]))))
    chars = common_prefix_length(F.col("header_truth"), F.col("header_response"))
    return probes.select(
        "corpus", "model", chars.alias("header_chars"), (chars / F.greatest(F.length("header_truth"), F.lit(1))).alias("header_share"),
        F.concat_ws("/", known.cast("string"), F.size(names).cast("string")).alias("names_recovered"), exact.cast("long").alias("rows_exact"),
    )


def probe_status(tests: DataFrame, names: list[str]) -> DataFrame:
    """ok, failed or - for each test of each model and corpus."""
    state = F.when(F.max(F.col("done").cast("int")) == 1, "ok").when(F.max(F.col("failed").cast("int")) == 1, "failed").otherwise("-")
    return tests.groupBy("model", "corpus").pivot("test", names).agg(state).na.fill("-")


def suspicious_tokens(calls: DataFrame) -> DataFrame:
    """Tokens a call; a handful means that answers were cut off."""
    per_call = F.col("tokens") / F.nullif("calls", F.lit(0))
    return calls.withColumn("tokens_per_call", per_call).withColumn("suspicious", F.coalesce((per_call > 0) & (per_call < 5), F.lit(False)))
