"""Cleaning of notebooks, one row per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns in order, with what they stand for.
SECRETS = (
    (r"sk-[A-Za-z0-9_\-]{20,}", "API key literal"),
    (r"api_key\s*=\s*['\"][^'\"]{20,}", "hard-coded api_key"),
    (r"ANTHROPIC_API_KEY\s*=\s*['\"]", "hard-coded key assignment"),
)
DROPS = (
    (r"LoggingAnthropicLLM|CAPTURED\b", "harness diagnostic"),
    (r"harness[_ ]diagnostic", "harness diagnostic"),
    (r"purge_failures\s*\(", "one-off run-log repair"),
    (r"importlib\.reload", "module hot-reload patch"),
    (r"N0_FIX|N2_PATCH|_PATCH\b", "patch cell"),
    (r"stop_reason\s*:.*block types", "API response probe"),
    (r"^\s*#\s*=+\s*\n#\s*(DIAGNOSTIC|PATCH)", "explicit diagnostic block"),
    (r"\.unlink\(\)|shutil\.rmtree", "destructive maintenance"),
)
NEUTRALISE = (
    (r"CLEAR_OLD\s*=\s*True", "CLEAR_OLD = False        # never clear on a fresh clone"),
    (r"force=True", "force=False             # reuse released outputs; set True to recompute"),
)
SHORT_MARKDOWN = 400


def source_text(lines: Column) -> Column:
    return F.array_join(lines, "")


def secret_hits(cells: DataFrame, texts: tuple[str, ...] = ("source",)) -> DataFrame:
    """One row per cell, text and secret pattern that occurs in it."""
    hits = F.array_compact(F.array(*[F.when(F.col(t).rlike(p), F.lit(name if t == "source" else f"{name} (in {t})")) for t in texts for p, name in SECRETS]))
    return cells.select("notebook", "pos", F.explode(hits).alias("secret"))


def drop_reason(source: Column, kind: Column) -> Column:
    """Why a code cell goes; null if it stays.  Cells that can be neutralised stay."""
    reason = F.lit(None).cast("string")
    for pattern, name in reversed(DROPS):
        reason = F.when(source.rlike("(?m)" + pattern), name).otherwise(reason)
    tame = F.lit(False)
    for pattern, _ in NEUTRALISE:
        tame = tame | source.rlike(pattern)
    return F.when((kind == "code") & ~tame, reason)


def neutralised(source: Column) -> Column:
    for pattern, text in NEUTRALISE:
        source = F.regexp_replace(source, pattern, text.replace("\\", "\\\\").replace("$", "\\$"))
    return source


def clean_cells(cells: DataFrame) -> DataFrame:
    """Kept cells of each notebook, rewritten and renumbered.

    A dropped cell also takes the short markdown cell that ends what is kept
    before it.  Of a run of ``k`` dropped cells each takes one, so of the
    unbroken short markdown cells before the run the last ``k`` go; ``cells``
    between runs without a drop form islands, numbered from their ends.
    """
    w = Window.partitionBy("notebook").orderBy("pos")
    rows = cells.withColumn("reason", drop_reason(F.col("source"), F.col("kind"))).withColumn("dropped", F.col("reason").isNotNull())
    short = (F.col("kind") == "markdown") & (F.length("source") < SHORT_MARKDOWN)
    rows = rows.withColumn("step", F.when(F.col("dropped"), -1).when(short, 1).otherwise(0))
    # a cell that is neither starts a new stretch: nothing before it can be popped any more
    rows = rows.withColumn("stretch", F.sum(F.when(F.col("step") == 0, 1).otherwise(0)).over(w))
    inside = Window.partitionBy("notebook", "stretch").orderBy("pos")
    rows = rows.withColumn("level", F.sum(F.when(F.col("step") == 0, 0).otherwise(F.col("step"))).over(inside))
    # pops on an empty stack have no effect: lift the walk by its least value so far
    rows = rows.withColumn("floor", F.least(F.lit(0), F.min("level").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    rows = rows.withColumn("height", F.col("level") - F.col("floor"))
    later = inside.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("least_later", F.min("height").over(later))
    popped = (F.col("step") == 1) & (F.coalesce(F.col("least_later"), F.col("height")) < F.col("height"))
    kept = rows.filter(~F.col("dropped") & ~popped)
    counted = F.when((F.col("kind") == "code") & F.col("executed"), 1).otherwise(0)
    return kept.select(
        "notebook", "pos", "kind", F.when(F.col("kind") == "code", neutralised(F.col("source"))).otherwise(F.col("source")).alias("source"),
        F.when(counted == 1, F.sum(counted).over(w)).cast("long").alias("execution_count"),
    )


def report(cells: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Kept, code and dropped cells of notebooks without secrets."""
    n = cells.groupBy("notebook").agg(F.count(F.lit(1)).alias("n_cells"))
    k = cleaned.groupBy("notebook").agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("kind") == "code").alias("n_code"))
    return n.join(k, "notebook", "left").join(secret_hits(cells).select("notebook").distinct(), "notebook", "left_anti").na.fill(0)
