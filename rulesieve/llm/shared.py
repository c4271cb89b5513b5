"""Helpers shared by the corpus operators: written stages and text columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files in a folder that is mounted locally are made without a child process that sets their mode; other stores take no notice.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it.  Only a local-mode session (tests,
    notebooks) may leave it unset; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="rulesieve-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


@contextmanager
def _shuffles_end_with_their_query(spark: SparkSession):
    """Inside, a finished write drops its shuffle files at once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def staged(df: DataFrame, name: str, dictionary: bool = True, few_files: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows survives lost executors without
    recomputing ``df``, and several readers share one computation.  The table is
    removed when the driver's process ends.  ``few_files`` deals rows that many
    tasks make few of into files of the session's advisory size first.

    In a local or mounted folder Hadoop starts two processes for each file, one
    for its mode and one for its checksum's, which share an executor's memory for
    a moment and are then counted as if they had as much; here there are none, and
    no checksum files either (Parquet pages are compressed with zstd).
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/rulesieve-{uuid.uuid4().hex}/{name}"
    writer = (df.hint("rebalance") if few_files else df).write.options(**_PLAIN_FILES).option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower())  # hashes gain nothing from one
    with _shuffles_end_with_their_query(spark):
        writer.parquet(path)
    atexit.register(_forget, spark, path.rpartition("/")[0])
    return spark.read.schema(df.schema).parquet(path)


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let whole texts go to Python in batches of ``rows``, so that few are in memory at once; a session that has set a value keeps it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def text_or_empty(column: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def one_row_each(docs: DataFrame, key: Column, kept: DataFrame, keys: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``first`` in ``kept``; ``keys`` has the ``d`` of all rows, repeats included.

    Only rows whose key repeats are shuffled.
    """
    repeated = keys.groupBy("d").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("d").alias("first"))
    (d,) = fresh_names(docs, "d")
    once = docs.withColumn(d, key)
    single, several = kept.join(repeated, "first", "left_anti"), kept.join(repeated, "first", "left_semi")
    alone = once.join(single, once[d] == single["first"], "left_semi")
    return alone.unionByName(once.join(several, once[d] == several["first"], "left_semi").dropDuplicates([d])).select(*docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
