"""Reproducible sharding by a Feistel permutation of global row numbers.

Rows get global numbers 0..n-1, a keyed Feistel network permutes the numbers,
and position ``p`` lies in shard ``p mod k`` at slot ``p div k``.  Anyone who
knows ``n``, ``k`` and the key can compute where row ``i`` lies, and back.

The permutation works on a grid of ``a * b`` cells, ``a = ceil(sqrt n)`` and
``b = ceil(n / a)``, so fewer than ``a`` cells lie beyond ``n``.  A row that
lands there walks on along its cycle; as each such cell is met at most once,
``a * b - n`` further steps always suffice, and only about one row in
``sqrt n`` walks at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, text_or_empty

ROUNDS = 4
NUMBERING_BUCKETS = 4096


def _mix(seed: int, step, value: Column, modulus: Column) -> Column:
    step = F.lit(step) if isinstance(step, int) else step
    return F.pmod(F.xxhash64(F.lit(seed), step.cast("int"), value), modulus)


def _permute_once(value: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network as a single expression, for use inside a walk."""
    start = F.struct(F.expr("0L").alias("pad"), F.floor(value / b).cast("long").alias("l"), F.pmod(value, b).alias("r"))

    def half(state: Column, i: Column) -> Column:
        left, right = state["l"], state["r"]
        turned_left = F.pmod(left + _mix(seed, i, right, a), a)
        turned_right = F.pmod(right + _mix(seed, i, left, b), b)
        even = i % 2 == 0
        return F.struct(
            F.expr("0L").alias("pad"),
            F.when(even, turned_left).otherwise(left).alias("l"),
            F.when(even, right).otherwise(turned_right).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, half, lambda s: s["l"] * b + s["r"])


def permuted(df: DataFrame, number: str, total: str, seed: int, out: str) -> DataFrame:
    """Add ``out``: the keyed permutation of ``number`` within 0..``total``-1."""
    a, b = F.col("__a"), F.col("__b")
    side = F.greatest(F.lit(1), F.ceil(F.sqrt(F.col(total)))).cast("long")
    df = df.withColumn("__a", side).withColumn("__b", F.greatest(F.lit(1), F.ceil(F.col(total) / a)).cast("long"))
    df = df.withColumns({"__l": F.expr(f"`{number}` div __b"), "__r": F.pmod(F.col(number), b)})
    for i in range(2 * ROUNDS):
        if i % 2 == 0:
            df = df.withColumn("__l", F.pmod(F.col("__l") + _mix(seed, i, F.col("__r"), a), a))
        else:
            df = df.withColumn("__r", F.pmod(F.col("__r") + _mix(seed, i, F.col("__l"), b), b))
    df = df.withColumn("__v", F.col("__l") * b + F.col("__r"))
    walk = F.aggregate(
        F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), a * b - F.col(total)).cast("long")),
        F.col("__v"),
        lambda v, _: F.when(v < F.col(total), v).otherwise(_permute_once(v, a, b, seed)),
    )
    df = df.withColumn(out, F.when(F.col("__v") < F.col(total), F.col("__v")).otherwise(walk))
    return df.drop("__a", "__b", "__l", "__r", "__v")


def numbered(rows: DataFrame, key: list[str], buckets: int = NUMBERING_BUCKETS) -> DataFrame:
    """Add ``row_number`` (0..n-1, gapless) and ``total`` without one global sort.

    Rows are dealt into ``buckets`` by a hash of ``key``, counted, and numbered
    inside their bucket from the bucket's offset.  The offsets are a table of at
    most ``buckets`` rows, so broadcasting it is bounded whatever the input.
    Pass a written table: it is read twice.
    """
    dealt = rows.withColumn("__bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    counts = dealt.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
    up_to = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "__bucket",
        F.coalesce(F.sum("__n").over(up_to), F.lit(0)).cast("long").alias("__offset"),
        F.sum("__n").over(everywhere).cast("long").alias("total"),
    )
    inside = Window.partitionBy("__bucket").orderBy(*key)
    return (
        dealt.withColumn("__i", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "__bucket")
        .withColumn("row_number", F.col("__i") + F.col("__offset"))
        .drop("__bucket", "__i", "__offset")
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, seed: int = 20260807, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents into ``n_shards`` shards whose counts differ by at most one.

    Returns ``id_col, size, text_crc32, row_number, total, position, shard, slot``.
    A null text has size 8 and checksum 0; null and repeated ids are rows like any
    other; fully identical rows are interchangeable.  An empty table gives an
    empty result.  Other columns of the input are not looked at.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    text = text_or_empty(text_col)
    facts = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = numbered(staged(facts, "sizes"), [id_col, "text_crc32", "size"])
    placed = permuted(rows, "row_number", "total", seed, "position")
    return placed.withColumns({
        "shard": F.pmod(F.col("position"), F.lit(n_shards)).cast("int"),
        "slot": F.expr(f"position div {int(n_shards)}"),
    })
