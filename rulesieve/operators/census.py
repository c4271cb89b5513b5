"""The column census: types, nulls, distinct values, quantiles, top levels."""

from __future__ import annotations

from functools import reduce
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import as_number, kind_of, present, quoted
from ..session import local_rows

# Fixed values.
TOP_LEVELS = 20
QUANTILES = (0.01, 0.25, 0.50, 0.75, 0.99)
NUMERIC_SHARE = 0.95
#: How far around an exact quantile its values are counted one by one, as shares of all rows: the next is tried if the sketch was further off.
MARGINS = (0.0003, 0.01)


def _level(df: DataFrame, column: str) -> Column:
    return F.when(present(df, column), F.col(quoted(column)).cast("string"))


def census(df: DataFrame, exact_distinct: bool = False, exact_quantiles: bool = False) -> DataFrame:
    """One row per column: ``column, logical_type, null_rate, distinct_count, min_value, max_value, q01..q99``.

    One pass with sketches of bounded size.  Exact quantiles take a second pass,
    which counts the values near each quantile one by one and those between as
    one; exact distinct counts take a pass over each column and a shuffle of its
    distinct values.  Both are worked out at once, not when the result is read.
    """
    columns = df.columns
    parts = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        number, there = as_number(df, c), present(df, c)
        quantile = F.percentile_approx(number, _probes() if exact_quantiles else [*QUANTILES], 10000)
        parts += [
            F.count_if(there).alias(f"v{i}"), F.count(number).alias(f"k{i}"), F.max((number % 1 != 0).cast("int")).alias(f"f{i}"),
            F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}"), quantile.alias(f"q{i}"),
        ]
        if not exact_distinct:
            parts.append(F.approx_count_distinct(_level(df, c)).alias(f"d{i}"))
    row = df.agg(*parts)
    if exact_quantiles or exact_distinct:
        found = row.first().asDict()  # column-sized
        if exact_quantiles:
            found |= {f"q{i}": q for i, q in _exact_quantiles(df, found).items()}
        if exact_distinct:
            found |= {f"d{i}": n for i, n in _distinct_counts(df).items()}
        types = {f.name: f.dataType for f in row.schema} | {f"q{i}": T.ArrayType(T.DoubleType()) for i in range(len(columns))}
        types |= {f"d{i}": T.LongType() for i in range(len(columns))}
        row = local_rows(df.sparkSession, [tuple(found.values())], T.StructType([T.StructField(c, types[c]) for c in found]))

    def kind(i: int, c: str) -> Column:
        native = kind_of(df, c)
        if native == "time":
            return F.lit("timestamp")
        if native in ("bool", "float"):
            return F.lit(native)
        if native == "numeric":
            return F.lit("float" if df.schema[c].dataType.typeName() == "decimal" else "int")
        enough = (F.col(f"v{i}") > 0) & (F.col(f"k{i}") >= NUMERIC_SHARE * F.col(f"v{i}"))
        return F.when(enough & (F.col(f"f{i}") == 0), "int").when(enough, "float").otherwise("string")

    facts = []
    for i, c in enumerate(columns):
        t = kind(i, c)
        numeric = t.isin("int", "float")
        facts.append(
            F.struct(
                F.lit(i).alias("place"), F.lit(c).alias("column"), t.alias("logical_type"),
                F.when(F.col("rows") > 0, 1 - F.col(f"v{i}") / F.col("rows")).alias("null_rate"),
                F.col(f"d{i}").alias("distinct_count"),
                F.when(numeric, F.col(f"lo{i}")).alias("min_value"), F.when(numeric, F.col(f"hi{i}")).alias("max_value"),
                *[F.when(numeric, F.col(f"q{i}")[j].cast("double")).alias(f"q{round(q * 100):02d}") for j, q in enumerate(QUANTILES)],
            )
        )
    return row.select(F.inline(F.array(*facts))).drop("place")


def _probes() -> list[float]:
    """The shares asked of a sketch for exact quantiles: for each margin and quantile one below and one above."""
    return [min(1.0, max(0.0, q + side * m)) for m in MARGINS for q in QUANTILES for side in (-1, 1)]


def _exact_quantiles(df: DataFrame, found: dict) -> dict[int, list[float] | None]:
    """For each place of a column its exact quantiles, interpolated; None for columns that are not numeric.

    ``found`` holds, for column ``i``, the number of numbers ``k``, their bounds ``lo`` and
    ``hi`` and the sketch's answers to ``_probes`` as ``q``.  The answers only bound what is counted
    one by one: ranks are exact, and one outside its bounds is looked for within wider ones.
    """
    columns = df.columns
    quantiles: dict[int, list[float] | None] = dict.fromkeys(range(len(columns)))
    shown = [i for i, c in enumerate(columns) if found[f"k{i}"] >= max(1, NUMERIC_SHARE * found[f"v{i}"]) and kind_of(df, c) != "bool"]
    ranks = {i: [(found[f"k{i}"] - 1) * q for q in QUANTILES] for i in shown}
    for m in range(len(MARGINS) + 1):
        open_columns = [i for i in ranks if quantiles[i] is None]
        if not open_columns:
            break
        counts = []
        for i in open_columns:
            probes = found[f"q{i}"][2 * len(QUANTILES) * m :]
            near = [(probes[2 * j], probes[2 * j + 1]) for j in range(len(QUANTILES))] if m < len(MARGINS) else [(found[f"lo{i}"], found[f"hi{i}"])]
            values = df.select(as_number(df, columns[i]).alias("v")).filter("v IS NOT NULL")
            counts.append(_near_counts(values, near).select(F.lit(i).alias("i"), "at", "v", "n"))
        end = F.sum("n").over(Window.partitionBy("i").orderBy("at", "v"))
        cells = reduce(DataFrame.unionByName, counts).withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
        wanted = F.lit(False)
        for i in open_columns:
            for r in sorted({f(r) for r in ranks[i] for f in (floor, ceil)}):
                wanted = wanted | ((F.col("i") == i) & (F.col("start") <= r) & (F.col("end") > r))
        rows = cells.filter(wanted).collect()  # two for each quantile
        for i in open_columns:
            at = lambda rank: next(x["v"] for x in rows if x["i"] == i and x["start"] <= rank < x["end"])  # noqa: B023, E731
            ends = [(r, floor(r), ceil(r), at(floor(r)), at(ceil(r))) for r in ranks[i]]
            if all(low is not None and high is not None for *_, low, high in ends):
                quantiles[i] = [low if low == high else (above - r) * low + (r - below) * high for r, below, above, low, high in ends]
    return quantiles


def _near_counts(values: DataFrame, near: list[tuple[float, float]]) -> DataFrame:
    """``at, v, n``: each value ``v`` within the bounds ``near`` with its count, those between as one with a null; ``at`` orders them."""
    merged: list[list[float]] = []
    for low, high in sorted(near):
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    v, at = F.col("v"), F.lit(2 * len(merged))
    for i, (low, high) in reversed(list(enumerate(merged))):
        at = F.when(v < F.lit(low), 2 * i).when(v <= F.lit(high), 2 * i + 1).otherwise(at)
    placed = values.select(at.alias("at"), "v")
    return placed.select("at", F.when(F.col("at") % 2 == 1, v).alias("v")).groupBy("at", "v").agg(F.count(F.lit(1)).alias("n"))


def _distinct_counts(df: DataFrame) -> dict[int, int]:
    """For each place of a column how many different texts its values have, counted by the values where these are as many."""
    counts = []
    for i, c in enumerate(df.columns):
        value, kind = F.col(quoted(c)), kind_of(df, c)
        keys = [value if kind in ("numeric", "bool", "time") else value.cast("string")]
        if kind == "float":  # the two zeros are equal, their texts are not
            keys = [value, F.when(value == 0, value.cast("string"))]
        elif isinstance(df.schema[c].dataType, T.TimestampType):  # hours that a clock shows twice have one text
            keys = [value.cast("timestamp_ntz")]
        cells = df.filter(present(df, c)).select(*[k.alias(f"k{j}") for j, k in enumerate(keys)]).distinct()
        counts.append(cells.agg(F.lit(i).alias("i"), F.count(F.lit(1)).alias("n")))
    return {r["i"]: r["n"] for r in reduce(DataFrame.unionByName, counts).collect()}


def level_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n`` of every value that occurs, nulls left out."""
    columns = columns or df.columns
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _level(df, c).alias("value")) for c in columns])).alias("x")
    return df.select(cells).select("x.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_levels(df: DataFrame, columns: list[str] | None = None, limit: int = TOP_LEVELS) -> DataFrame:
    """The most frequent values of each column, ties by value: ``column, value, n, place``."""
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "value")
    return level_counts(df, columns).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= limit)


def modal_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each column's most frequent value and its share of all rows."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return top_levels(df, columns, 1).join(F.broadcast(rows)).select("column", "value", (F.col("n") / F.col("rows")).alias("rate"))


def without_levels(df: DataFrame) -> DataFrame:
    """Columns that have no value at all."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    return names.join(top_levels(df, limit=1).select("column"), "column", "left_anti")


def doc_coverage(columns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Documented and undocumented columns, orphaned entries, and the documented share."""
    known = dictionary.filter(F.length(F.trim("doc")) > 0)
    lists = lambda d, name: d.agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    a = lists(columns.join(known, "column", "left_semi"), "documented")
    b = lists(columns.join(known, "column", "left_anti"), "undocumented")
    c = lists(dictionary.select("column").join(columns, "column", "left_anti"), "orphaned")
    share = F.coalesce(F.round(F.col("n_documented") / F.nullif(F.col("n_documented") + F.col("n_undocumented"), F.lit(0)), 4), F.lit(0.0))
    return a.join(F.broadcast(b)).join(F.broadcast(c)).withColumn("coverage", share)


def attach_docs(columns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add ``doc`` from a dictionary of (column, doc); an undocumented column has the empty text."""
    return columns.join(F.broadcast(dictionary.select("column", "doc")), "column", "left").withColumn("doc", F.coalesce("doc", F.lit("")))


def docs_of(dictionary: DataFrame, corpus: str) -> DataFrame:
    """``column, doc`` of one corpus of a dictionary of (corpus, column, doc); none if it is not registered."""
    return dictionary.filter(F.col("corpus") == corpus).select("column", "doc")


#: What a record of facts holds for each column.
FACTS = (
    "corpus string, row_count long, table_doc string, columns array<struct<name: string, dtype: string, doc: string, null_rate: double, distinct_count: long, "
    "min_value: double, max_value: double, quantiles: map<string, double>, top_levels: array<struct<value: string, n: long>>>>"
)


def facts_record(facts: DataFrame, levels: DataFrame, corpus: str, rows: int, table_doc: str = "") -> DataFrame:
    """One row of ``FACTS`` from census rows with ``place`` and ``doc``, and their levels."""
    listed = levels.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_levels"))
    names = [f"q{round(q * 100):02d}" for q in QUANTILES]
    quantiles = F.map_filter(F.create_map(*[x for n in names for x in (F.lit(f"p{n[1:]}"), F.col(n))]), lambda _, v: v.isNotNull())
    one = F.struct(
        "place", F.col("column").alias("name"), F.col("logical_type").alias("dtype"), "doc", "null_rate", "distinct_count", "min_value", "max_value", quantiles.alias("quantiles"),
        F.coalesce("top_levels", F.array().cast("array<struct<value: string, n: long>>")).alias("top_levels"),
    )
    columns = F.transform(F.array_sort(F.collect_list(one), lambda a, b: (a["place"] - b["place"]).cast("int")), lambda x: x.dropFields("place"))
    return facts.join(listed, "column", "left").agg(F.lit(corpus).alias("corpus"), F.lit(rows).cast("long").alias("row_count"), F.lit(table_doc).alias("table_doc"), columns.alias("columns"))


def save_facts(record: DataFrame, path: str) -> str:
    """Write a record of facts as JSON; the SHA-256 of the JSON text, which a later ``load_facts`` gives again."""
    text = record.select(F.to_json(F.struct(*record.columns)).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)
    return record.sparkSession.read.text(path).agg(F.sha2(F.max("value"), 256)).first()[0]


def load_facts(spark: SparkSession, path: str) -> DataFrame:
    """The record in ``path`` with its ``content_sha256``; missing documentation is empty, missing lists are too."""
    read = spark.read.text(path).select(F.from_json("value", FACTS).alias("x"), F.sha2("value", 256).alias("content_sha256")).select("x.*", "content_sha256")
    whole = F.transform("columns", lambda c: c.withField("doc", F.coalesce(c["doc"], F.lit(""))).withField("top_levels", F.coalesce(c["top_levels"], F.array().cast("array<struct<value: string, n: long>>"))))
    return read.withColumn("table_doc", F.coalesce("table_doc", F.lit(""))).withColumn("columns", whole)
