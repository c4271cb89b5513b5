"""Registered tables and files: readers, guards, provenance, exports."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Corpus:
    """How a corpus is read; parts are read in order and concatenated."""

    name: str
    paths: tuple[str, ...]
    format: str = "parquet"
    schema: str | None = None
    options: dict = field(default_factory=dict)
    expected_rows: int | None = None


class Registry:
    def __init__(self, *corpora: Corpus):
        self._known = {c.name: c for c in corpora}

    def __getitem__(self, name: str) -> Corpus:
        if name not in self._known:
            raise KeyError(f"{name!r} is not registered")
        return self._known[name]

    def load(self, spark: SparkSession, name: str, check_rows: bool = False) -> DataFrame:
        corpus = self[name]
        out = None
        for path in corpus.paths:
            part = read(spark, path, corpus.format, corpus.schema, corpus.options)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if check_rows and corpus.expected_rows is not None and (n := out.count()) != corpus.expected_rows:
            raise ValueError(f"{name}: {n} rows, {corpus.expected_rows} expected")
        return out


def _must_exist(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        raise FileNotFoundError(path)


def read(spark: SparkSession, path: str, format: str, schema: str | None = None, options: dict | None = None) -> DataFrame:
    _must_exist(spark, path)
    if format == "parquet":
        return spark.read.parquet(path)
    if format == "csv":
        return read_csv(spark, path, schema, **(options or {}))
    if format == "jsonl":
        return read_log(spark, path, schema)
    if format == "excel":
        return read_excel(spark, path)
    raise ValueError(f"no reader for {format!r}")


def read_csv(spark: SparkSession, path: str, schema: str | None, **options: str) -> DataFrame:
    """CSV in which no text means null: empty fields are empty texts."""
    if schema is None:
        raise ValueError("CSV needs a schema")
    df = spark.read.schema(schema).options(header="true", nullValue="\u0000", emptyValue="", **options).csv(path)
    return df.na.fill("", [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """All sheets in order, if a workbook reader is installed."""
    import pandas as pd

    sheets = pd.read_excel(path, sheet_name=None, keep_default_na=False, na_values=[""])
    return spark.createDataFrame(pd.concat(sheets.values(), ignore_index=True))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank or damaged lines are skipped."""
    wide = T._parse_datatype_string(schema).add("_bad", T.StringType())
    return spark.read.schema(wide).option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad IS NULL").drop("_bad")


def append_log(rows: DataFrame, path: str, key: list[str] | None = None) -> None:
    """Append JSON lines; with a key, rows whose key the log has already are left out, so a repeated append changes nothing."""
    if key:
        try:
            known = read_log(rows.sparkSession, path, rows.select(*key).schema.simpleString()[7:-1].replace(":", " "))
        except AnalysisException:  # no log yet
            known = None
        rows = rows.dropDuplicates(key)
        rows = rows if known is None else rows.join(known, key, "left_anti")
    rows.write.mode("append").json(path)


def export(df: DataFrame, path: str, format: str = "csv") -> None:
    """A report-sized table as one file, committed as a whole."""
    save_artifact(df.coalesce(1), path, format)


#: Kinds of artefacts and how they are written: format and options.
KINDS = {
    "csv": ("csv", {"header": "true", "nullValue": r"\N"}), "json": ("json", {"ignoreNullFields": "false"}), "jsonl": ("json", {"ignoreNullFields": "false"}),
    "parquet": ("parquet", {}), "text": ("text", {}),
}


def save_artifact(df: DataFrame, path: str, kind: str) -> None:
    """Write beside ``path``, then move into its place: readers see the old artefact or the new one, whole.

    ``json`` is one record in one file, ``text`` a table with one text column.
    """
    if kind not in KINDS:
        raise ValueError(f"no writer for {kind!r}")
    format, options = KINDS[kind]
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
    (df.coalesce(1) if kind == "json" else df).write.options(**options).format(format).save(beside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, new = hadoop(path), hadoop(beside)
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{beside} could not be moved to {path}")


def load_artifact(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """What ``save_artifact`` wrote; CSV and JSON need their schema."""
    if kind not in KINDS:
        raise ValueError(f"no reader for {kind!r}")
    if kind in ("csv", "json", "jsonl") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    _must_exist(spark, path)
    format, options = KINDS[kind]
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(format).load(path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def discover(spark: SparkSession, root: str, suffix: str, fragment: str) -> DataFrame:
    """The largest file under ``root`` whose name holds the fragment."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    found = files.select("path", "length").filter(F.contains(F.lower(F.element_at(F.split("path", "/"), -1)), F.lit(fragment.lower())))
    return found.agg(F.max_by("path", "length").alias("path"), F.max("length").alias("length"))


def assert_counts(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """Counts of chosen values in one pass; a wrong one fails the query."""
    row = df.agg(*[F.count_if(c).alias(name) for name, (c, _) in expected.items()])
    ok = lambda name, n: F.when(F.col(name) == n, F.col(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: {n} expected, found "), F.col(name).cast("string"))).cast("long"))
    return row.select(*[ok(name, n).alias(name) for name, (_, n) in expected.items()])


def head_rows(df: DataFrame, row_id: str, n: int = 2000) -> DataFrame:
    return df.orderBy(row_id).limit(n)


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """One row per cell of notebook files."""
    schema = "cells array<struct<cell_type:string, source:array<string>, execution_count:long, outputs:array<struct<text:array<string>>>>>"
    files = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("notebook", F.input_file_name())
    return files.select("notebook", F.posexplode("cells").alias("pos", "c")).select(
        "notebook", "pos", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("source"),
        F.col("c.execution_count").isNotNull().alias("executed"), F.array_join(F.flatten(F.transform("c.outputs", lambda o: F.coalesce(o["text"], F.array().cast("array<string>")))), "").alias("OUTPUT"),
    )


def write_notebooks(cells: DataFrame, path: str) -> None:
    """Cells of ``read_notebooks`` or ``clean_cells`` as notebook documents, without outputs: a folder ``notebook=NAME`` each."""
    count = F.col("execution_count") if "execution_count" in cells.columns else F.lit(None).cast("long")
    source = F.filter(F.split(F.regexp_replace("source", "\n", "\n\u0000"), "\u0000"), lambda line: line != "")
    code = F.to_json(F.struct(F.lit("code").alias("cell_type"), count.alias("execution_count"), F.create_map().alias("metadata"), F.array().cast("array<string>").alias("outputs"), source.alias("source")), {"ignoreNullFields": "false"})
    prose = F.to_json(F.struct(F.col("kind").alias("cell_type"), F.create_map().alias("metadata"), source.alias("source")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("kind") == "code", code).otherwise(prose).alias("cell"))))
    body = F.array_join(F.transform(ordered, lambda x: x["cell"]), ",")
    documents = cells.groupBy("notebook").agg(F.concat(F.lit('{"cells":['), body, F.lit('],"metadata":{},"nbformat":4,"nbformat_minor":5}')).alias("value"))
    documents.write.partitionBy("notebook").text(path)
