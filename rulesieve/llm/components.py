"""Connected components of a large sparse graph, by iterated joins.

Alternates the large-star and small-star steps of Kiveris et al., "Connected
Components in MapReduce and Beyond" (2014): each step only groups a node's
neighbours by their minimum, so no component is ever held in one place, and the
number of rounds grows with the logarithm of the component's size.  Once no more
than ``FEW`` edges are left, one task ends the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

#: Edges that one task joins up: some tens of MB.
FEW = 50_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (least node, node) for each node of the edges but the least ones."""
    nodes: list = []
    place: dict = {}
    above: list[int] = []

    def number(node: object) -> int:
        key = tuple(node.values()) if isinstance(node, dict) else node
        if key not in place:
            place[key] = len(nodes)
            nodes.append(node)
            above.append(len(above))
        return place[key]

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            above[root(number(a))] = root(number(b))
    if schema is None:
        return
    least: dict[int, object] = {}
    for key, i in place.items():
        r = root(i)
        least[r] = min(least.get(r, key), key)
    rows = [(nodes[place[least[root(i)]]], nodes[i]) for key, i in place.items() if key != least[root(i)]]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in (0, 1)], names=["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.filter("b > a").join(least, "a").filter("b != m")
        .select(F.col("m").alias("a"), "b").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # a < b in every edge here; b's smaller neighbours and b itself move to the least of them
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame, rounds: int = 60, few: int = FEW) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges(a, b)``.

    ``component`` is the least node of the component.  Self-loops, repeated edges
    and either direction are allowed; nulls must be filtered out beforehand.
    """
    current = staged(
        edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    before = None
    for _ in range(rounds):
        if (before[0] if before else current.count()) <= few:
            kinds = ", ".join(f"{c} {current.schema[c].dataType.simpleString()}" for c in "ab")
            current = staged(current.coalesce(1).mapInArrow(_joined, kinds), "stars")
            break
        current = staged(_small_star(_large_star(current)), "stars")
        state = current.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(current.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
