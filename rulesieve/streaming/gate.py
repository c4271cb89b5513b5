"""Rules over streams: a stateless gate, windowed retention, streaming unique."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import NotExecutable, Rule, mask


def gate(stream: DataFrame, rules: list[Rule], honour_severity: bool = False) -> DataFrame:
    """Rows with ``passes``; row rules only.  With ``honour_severity``, warnings pass."""
    tests = []
    for r in rules:
        if r.predicate == "unique":
            raise ValueError("unique needs state: use first_of_each")
        if honour_severity and r.severity == "warn":
            continue
        try:
            tests.append(mask(stream, r))
        except NotExecutable:
            continue
    return stream.withColumn("passes", reduce(and_, tests, F.lit(True)))


def windowed_retention(stream: DataFrame, rules: list[Rule], time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Share of passing rows in each tumbling window, late rows within the watermark."""
    gated = gate(stream.withWatermark(time, late), rules)
    return gated.groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("passes").cast("double")).alias("retention"))


def first_of_each(stream: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
