"""A corpus pipeline over ``documents``: five stages, each one corpus operator.

Every stage works on all its predecessor kept, is written as Parquet and read
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesieve.llm import decontam, linededup, packing, simhash, toxicity
from rulesieve.llm.shared import bounded_batches, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the limit.

    Null and empty texts have the training rate, at most 0.5, and stay; repeated
    rows stay or go together; null and repeated ids do not matter here.
    """
    bounded_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select(*COLUMNS), model)
    return scored.filter(F.col("__score") < toxicity.LIMIT).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; documents left empty by that go.

    ``n_chars`` counts the characters of the new text.  Null, empty and blank
    texts stay as they are; rows that repeat id and text are treated alike, and
    of equal lines in rows of one id the one of the lesser text hash is first.
    """
    cleaned = linededup.without_repeated_lines(docs.select(*COLUMNS, F.length("text").alias("__before")))
    return (
        cleaned.filter(~F.coalesce(F.length("text") < F.col("__before"), F.lit(False)) | F.col("text").rlike(r"\S"))
        .withColumn("n_chars", F.when(F.length("text") == F.col("__before"), F.col("n_chars")).otherwise(F.length("text").cast("long")))
        .select(*COLUMNS)
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that SimHash links and five-word shingles with a Jaccard similarity of 0.8 or more confirm.

    Texts without words are copies of each other; of rows that repeat id and text
    one stays; a null id comes after all others.
    """
    return simhash.without_near_copies(docs.select(*COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs; null and empty texts stay."""
    bounded_batches(spark)
    return decontam.without_benchmark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece of a document; a null or empty text is one token."""
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Trained scores, fingerprints and token ids are beyond SQL; tests/llm compares
#: each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
