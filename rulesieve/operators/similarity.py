"""Similarity of rule sets and its stability over repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def canonical_sets(rules: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Each set's distinct executable rules; sets without rules stay, empty."""
    grouped = rules.filter("executable").groupBy(*keys).agg(F.collect_set("canonical").alias("items"))
    return sets.select(*keys).join(grouped, keys, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def stability(sets: DataFrame, cell: list[str], seed: str = "seed") -> DataFrame:
    """Mean and least Jaccard over all seed pairs of each cell with two sets or more."""
    a = sets.select(*cell, F.col(seed).alias("seed_a"), F.col("items").alias("items_a"))
    b = sets.select(*cell, F.col(seed).alias("seed_b"), F.col("items").alias("items_b"))
    pairs = a.join(b, cell).filter("seed_a < seed_b").withColumn("jaccard", jaccard(F.col("items_a"), F.col("items_b")))
    counts = sets.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_seeds"))
    return pairs.groupBy(*cell).agg(F.avg("jaccard").alias("jaccard_mean"), F.min("jaccard").alias("jaccard_min")).join(counts, cell)


def unstable_share(cells: DataFrame, below: float = 0.80) -> DataFrame:
    return cells.agg(F.avg((F.col("jaccard_mean") < below).cast("double")).alias("unstable_share"), F.avg("jaccard_mean").alias("overall_mean"))
