"""Reproducible splits and samples by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SEED, AUTHORING = 20260807, 0.20


def hash_key(row_id: str, seed: int | str = SEED) -> Column:
    """md5 of seed and id: the order in which rows are drawn."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")).cast("binary"))


def split(df: DataFrame, row_id: str, fraction: float = AUTHORING, seed: int | str = SEED, name: str = "authoring") -> DataFrame:
    """Add boolean ``name``: the first round(fraction * n) rows in hash order.

    What is broadcast is 4096 counts at most.
    """
    ranked = with_rank(df, hash_key(row_id, seed), row_id)
    return ranked.withColumn(name, F.col("__rank") <= F.bround(F.lit(fraction) * F.col("__n"), 0)).drop("__rank", "__n")


def with_rank(df: DataFrame, key: Column, row_id: str, among: Column | None = None) -> DataFrame:
    """Add ``__rank`` by a hexadecimal key and id, from 1, and ``__n``, the number of rows; ``among``: only of rows for which it holds.

    Rows are ranked inside 4096 prefixes of the key and prefixes are offset by
    their counts, so no task sorts the whole table.  Rows that are not among
    those ranked get null.
    """
    counts_in = F.lit(True) if among is None else among
    keyed = df.withColumn("__key", key).withColumn("__prefix", F.substring("__key", 1, 3)).withColumn("__in", counts_in)
    counts = keyed.groupBy("__prefix").agg(F.count_if("__in").alias("__c"))
    before = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("__prefix", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(everywhere).alias("__n"))
    inside = F.row_number().over(Window.partitionBy("__prefix", "__in").orderBy("__key", row_id))
    ranked = keyed.withColumn("__i", inside).join(F.broadcast(offsets), "__prefix")
    return ranked.withColumn("__rank", F.when(F.col("__in"), F.col("__i") + F.col("__before"))).drop("__key", "__prefix", "__i", "__before", "__in")


def sample(df: DataFrame, row_id: str, n: int, seed: int | str = SEED) -> DataFrame:
    """``n`` rows by hash order."""
    return df.orderBy(hash_key(row_id, seed), row_id).limit(n)


def payload_rows(df: DataFrame, row_id: str, first: int = 200, n: int = 20, seed: int | str = SEED) -> DataFrame:
    """Of the first rows, a sample in row order."""
    return sample(df.orderBy(row_id).limit(first), row_id, n, seed).orderBy(row_id)


def manifest(df: DataFrame, row_id: str, flag: str) -> DataFrame:
    """Counts and an order-free digest of both sides of a split.

    The digest sums 128 bits of md5 over ids, so it needs no sort and no list of
    ids in one place.
    """
    digest = lambda at: F.sum(F.conv(F.substring(F.md5(F.col(row_id).cast("string").cast("binary")), at, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.groupBy(F.col(flag).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id"), F.concat_ws("-", digest(1), digest(9)).alias("digest")
    )


def check_split(whole: DataFrame, part_a: DataFrame, part_b: DataFrame, row_id: str, fraction: float = AUTHORING) -> DataFrame:
    """Disjoint, exhaustive and of the right size."""
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    shared = part_a.join(part_b.select(row_id), row_id, "left_semi")
    row = n(whole, "total").join(F.broadcast(n(part_a, "a"))).join(F.broadcast(n(part_b, "b"))).join(F.broadcast(n(shared, "shared")))
    return row.select(
        "total", "a", "b", (F.col("shared") == 0).alias("disjoint"), (F.col("a") + F.col("b") == F.col("total")).alias("exhaustive"),
        (F.abs(F.col("a") / F.col("total") - fraction) <= 0.001).alias("fraction_ok"),
    )


def counterfactuals(df: DataFrame, row_id: str, block: Column, seed: int | str = SEED) -> DataFrame:
    """Add ``drop_block``, ``drop_random`` and ``drop_outside``: equally many rows each."""
    flagged = df.withColumn("drop_block", F.coalesce(block, F.lit(False)))
    size = flagged.agg(F.count_if("drop_block").alias("__size"))
    flagged = with_rank(flagged, hash_key(row_id, seed), row_id).withColumnRenamed("__rank", "__first").drop("__n")
    ranked = with_rank(flagged, hash_key(row_id, f"{seed}:outside"), row_id, ~F.col("drop_block")).join(F.broadcast(size))
    return ranked.withColumns({
        "drop_random": F.col("__first") <= F.col("__size"), "drop_outside": ~F.col("drop_block") & (F.coalesce("__rank", F.lit(0)) <= F.col("__size")),
    }).drop("__first", "__rank", "__n", "__size")


def bootstrap_ci(values: list[float], resamples: int = 10_000, seed: int = SEED) -> tuple[float, float, float]:
    """Mean and 95 % interval of a small metric vector; NaN left out, empty: NaN."""
    import numpy as np

    x = np.array([v for v in values if v is not None and v == v], float)
    if not len(x):
        return (float("nan"),) * 3
    means = np.random.default_rng(seed).choice(x, (resamples, len(x))).mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(x.mean()), float(low), float(high)
