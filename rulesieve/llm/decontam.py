"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may differ from a passage by up to
``k = floor(rate * m)`` edits.  Cut into ``k + 1`` pieces, at least one piece
then occurs in the passage unchanged.  One automaton of all pieces runs over
every whole text; each hit names a window, and Myers' bit-parallel distance
decides whether the item occurs there within its budget.

The benchmark is the query set and goes to every task by broadcast, in blocks of
at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, of which the driver
holds one at a time: a longer benchmark takes more passes, never more memory.
Documents are neither shuffled nor collected.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_names

RATE = 0.08
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 5_000_000
_SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, none at the ends."""
    return _SPACE.sub(" ", (text or "").lower()).strip(" ")


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``item`` in ``k + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(i, item[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def peq(item: str) -> dict[str, int]:
    table: dict[str, int] = {}
    for i, c in enumerate(item):
        table[c] = table.get(c, 0) | 1 << i
    return table


def myers_best(table: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to a substring of ``text``, its end)."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score = mask, 0, m
    best, end = m, 0
    for at, c in enumerate(text, 1):
        eq = table.get(c, 0)
        x = eq | vn
        d0 = ((((eq & vp) + vp) ^ vp) | x) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1) & mask
        vp = ((hn << 1) & mask) | (mask & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = []
        where: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            k = budget(len(text), rate)
            for offset, piece in pieces(text, k):
                where.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, k, peq(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, distance, end in the normal form, item's length) of items that occur in ``text``."""
        if self.automaton is None or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            first = last - length + 1
            for item, offset in places:
                k, m = self.items[item][2], len(self.items[item][1])
                lo, hi = max(0, first - offset - k), min(len(text), first - offset + m + k)
                runs = windows.setdefault(item, [])
                if runs and lo <= runs[-1][1] and hi >= runs[-1][0]:
                    runs[-1] = [min(lo, runs[-1][0]), max(hi, runs[-1][1])]
                else:
                    runs.append([lo, hi])
        out = []
        for item, runs in windows.items():
            item_id, pattern, k, table = self.items[item]
            best = (k + 1, 0)
            for lo, hi in runs:
                if k == 0:
                    at = text.find(pattern, lo, hi)
                    distance, end = (0, at + len(pattern)) if at >= 0 else (1, 0)
                else:
                    distance, end = myers_best(table, len(pattern), text[lo:hi])
                    end += lo
                best = min(best, (distance, end))
            if best[0] <= k:
                out.append((item_id, *best, len(pattern)))
        return out


class Block:
    """A block of items that tasks get by broadcast; a worker keeps the automaton of the last one."""

    def __init__(self, spark: SparkSession, items: list[tuple[object, str]], rate: float):
        self.name, self.rate = uuid.uuid4().hex, rate
        self.items = spark.sparkContext.broadcast(sorted(items, key=repr))

    def matcher(self) -> Matcher:
        if self.name not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[self.name] = Matcher(self.items.value, self.rate)
        return _MATCHERS[self.name]


_MATCHERS: dict[str, Matcher] = {}


def _match(batches: Iterator[pa.RecordBatch], block: Block, item_kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    matcher = block.matcher()
    find = matcher.find
    names = ["item_id", "distance", "end_at", "item_chars"]
    for batch in batches:
        origins: list[int] = []
        rows: list[list] = [[], [], [], []]
        for place, text in enumerate(batch.column(1)):
            for item_id, distance, end, size in find(normal(text.as_py())):
                origins.append(place)
                for column, v in zip(rows, (item_id, distance, end, size), strict=True):
                    column.append(v)
        kinds = [item_kind, pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(origins, pa.int64())), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=["__id", *names]
        )


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float) -> Iterator[Block]:
    """The benchmark's distinct items, read one bounded block at a time."""
    spark = benchmark.sparkSession
    block: list[tuple[object, str]] = []
    chars = 0
    rows = benchmark.select(item_col, text_col).filter(F.col(text_col).isNotNull()).distinct()
    for item_id, text in rows.toLocalIterator(prefetchPartitions=False):
        text = normal(text)
        if not text:
            continue
        block.append((item_id, text))
        chars += len(text)
        if len(block) >= BLOCK_ITEMS or chars >= BLOCK_CHARS:
            yield Block(spark, block, rate)
            block, chars = [], 0
    if block:
        yield Block(spark, block, rate)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and item that occurs in it within its budget.

    Returns ``id_col, item_id, distance, end_at, item_chars``: the least
    distance, where that occurrence ends in the text's normal form, and the
    item's length.  Null or empty texts and items match nothing; null and
    repeated document ids are rows like any other; of several benchmark rows
    with one id, any that occurs counts.  Empty tables give an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    schema = f"__id {kind}, item_id {item_type.simpleString()}, distance int, end_at bigint, item_chars bigint"
    arrow_kind = to_arrow_type(item_type)
    found = None
    for block in _blocks(benchmark, item_col, item_text_col, rate):
        part = rows.mapInArrow(lambda it, b=block: _match(it, b, arrow_kind), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    return found.withColumnRenamed("__id", id_col)


def _without(batches: Iterator[pa.RecordBatch], block: Block, text_name: str) -> Iterator[pa.RecordBatch]:
    find = block.matcher().find
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(text_name))
        keep = [not find(normal(t.as_py())) for t in text]
        yield batch.filter(pa.array(keep, pa.bool_()))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no item occurs, all columns unchanged, without a join.

    Null and empty texts stay, and so do all rows if the benchmark is empty or has
    only null or blank items; rows that repeat stay or go together; null and
    repeated ids do not matter, nor does any name of a column.
    """
    (text,) = fresh_names(docs, "text")
    rows = docs.withColumn(text, F.col(text_col).cast("string"))
    for block in _blocks(benchmark, item_col, item_text_col, rate):
        rows = rows.mapInArrow(lambda it, b=block: _without(it, b, text), rows.schema)
    return rows.drop(text)
