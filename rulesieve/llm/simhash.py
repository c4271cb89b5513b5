"""SimHash near-duplicates by multi-index hashing.

A fingerprint holds, for each of 64 bits, whether that bit is set in over half
of the hashes of a text's word shingles.  Two texts link when their
fingerprints differ in at most four bits.

Search: cut the fingerprint into so many segments that one of them differs in at
most two bits (for four bits two segments of 32), so the balls of radius one
around both values share a point.  Every distinct fingerprint is entered under
the points around each of its segments (66 entries for two segments, whatever
the input), and all members of an entry are verified by full distance.

An entry's members arrive sorted.  Up to ``SMALL`` of them are all compared; up
to ``BUCKET`` in place, leaving a spanning forest of their links, never all
pairs.  Larger entries - crowds of near copies - are dealt out again.  For four
bits, under all 2081 fingerprints within two bits of their own: members of one
such ball are within four bits of each other by construction, and any two
fingerprints within four bits share one, so a star per ball loses no link.  For
more bits, under the points around segments cut at other places.

Where links are verified on the texts as well, a forest is not enough: its links
need not hold where others do.  Members of entries that had one are then compared
again, all pairs but those that verified links have connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import one_row_each, staged, text_or_empty

SHINGLE = 4
SEED = 42
DIFFERING_BITS = 4
#: Members of an index entry that are compared with each other in one task.
BUCKET = 16384
#: Up to so many all pairs of an entry are compared; beyond, a spanning forest of the links is enough.
SMALL = 64
#: Of the search for near copies to remove: words of a shingle, differing bits, least Jaccard similarity of shingle sets.
COPY_SHINGLE, COPY_BITS, COPY_SIMILARITY = 5, 8, 0.8
_BITS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def shingle_hashes(text: str, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of ``width`` words, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - width]).tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes; zero if there are none."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[counts * 2 > len(hashes)].sum(dtype=np.uint64))


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [simhash(shingle_hashes(t.as_py() or "", width)) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["__id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """``__id`` and the signed 64-bit ``fp`` of every row; null text is empty text."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, width), f"__id {kind}, fp bigint")


def _forest(members: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among ``members``."""
    rest = np.arange(len(members))
    left: list[int] = []
    right: list[int] = []
    reached: list[int] = []
    while len(rest):
        if reached:
            i = reached.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
        near = np.bitwise_count(members[rest] ^ members[i]) <= bits
        if near.any():
            found = rest[near].tolist()
            rest = rest[~near]
            left += [i] * len(found)
            right += found
            reached += found
    return left, right


def _runs(keys: np.ndarray, values: np.ndarray, bits: int, bucket: int, members: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Links ``(a, b, None)`` inside each run of equal keys; members of crowded runs, and if asked of those with a forest only, as ``(fp, key, crowd)``."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    sizes = ends - starts
    large = sizes > min(SMALL, bucket)
    for i, j in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        if j - i > bucket:
            yield values[i:j], keys[i:j], np.ones(j - i, bool)
            continue
        if members:
            yield values[i:j], keys[i:j], np.zeros(j - i, bool)
        left, right = _forest(values[i:j].view(np.uint64), bits)
        if left:
            yield values[i:j][left], values[i:j][right], None
    left_over = np.where(large, starts, ends).repeat(sizes)  # where each row's run ends; large runs are done
    at = np.arange(len(keys))
    prints = values.view(np.uint64)
    for step in range(1, SMALL):
        at = at[at + step < left_over[at]]
        if not len(at):
            break
        near = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= bits]
        if len(near):
            yield values[near], values[near + step], None


def _verify(batches: Iterator[pa.RecordBatch], bits: int, bucket: int, members: bool = False) -> Iterator[pa.RecordBatch]:
    """Links inside each run of equal keys, as (a, b, null); members of crowded entries as (fp, null, key), of those with a forest only as (fp, fp, key)."""
    keys, values, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None

    def out(a: np.ndarray, b: np.ndarray, crowd: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        other = pa.array(b) if crowd is None else none if crowd.all() else pa.array(a)
        return pa.RecordBatch.from_arrays([pa.array(a), other, none if crowd is None else pa.array(b)], names=["a", "b", "k"])

    for batch in batches:
        keys = np.concatenate([keys, np.asarray(batch.column(0))])
        values = np.concatenate([values, np.asarray(batch.column(1))])
        if crowded is not None:
            n = int(np.searchsorted(keys, crowded, side="right"))
            if n:
                yield out(values[:n], keys[:n], np.ones(n, bool))
            keys, values = keys[n:], values[n:]
        if not len(keys):
            continue
        crowded = None
        open_from = int(np.searchsorted(keys, keys[-1]))
        if open_from:
            for found in _runs(keys[:open_from], values[:open_from], bits, bucket, members):
                yield out(*found)
        keys, values = keys[open_from:], values[open_from:]
        if len(keys) > bucket:
            yield out(values, keys, np.ones(len(keys), bool))
            crowded, keys, values = keys[0], keys[:0], values[:0]
    if len(keys):
        for found in _runs(keys, values, bits, bucket, members):
            yield out(*found)


def _entries(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under the points around its segments."""
    segments = bits // 3 + 1
    cuts = [64 * i // segments for i in range(segments + 1)]
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        for i in range(0, len(fp), 4096):
            some = fp[i : i + 4096]
            keys, members = [], []
            for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                flips = np.concatenate([[np.uint64(0)], _BITS[: high - low]])
                part = some >> np.uint64(low) & np.uint64((1 << high - low) - 1)
                keys.append((part[:, None] ^ flips).ravel() | np.uint64(k) << np.uint64(32))
                members.append(np.repeat(some, len(flips)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(members).view(np.int64))], names=["k", "fp"])


def _entries_in_crowds(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Members (fp, k) of crowded entries, under their entry and the points around segments of the whole fingerprint cut elsewhere."""
    segments = bits // 3 + 1
    cuts = [64 * i // segments for i in range(segments)]
    width = 64 // segments
    for batch in batches:
        fp, entry = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1)).view(np.uint64)
        for i in range(0, len(fp), 4096):
            some, keys = fp[i : i + 4096], []
            turned = some << np.uint64(width // 2) | some >> np.uint64(64 - width // 2)
            for k, low in enumerate(cuts):
                high = cuts[k + 1] if k + 1 < segments else 64
                flips = np.concatenate([[np.uint64(0)], _BITS[: high - low]])
                part = turned >> np.uint64(low) & np.uint64((1 << high - low) - 1)
                point = (part[:, None] ^ flips).ravel() | np.uint64(k) << np.uint64(32)
                keys.append((point * np.uint64(0x9E3779B97F4A7C15)) ^ (np.repeat(entry[i : i + 4096], len(flips)) * np.uint64(0xC2B2AE3D27D4EB4F)))
            members = np.concatenate([np.repeat(some, 1 + (cuts[k + 1] if k + 1 < segments else 64) - low) for k, low in enumerate(cuts)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(members.view(np.int64))], names=["k", "fp"])


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under every fingerprint within two bits of it."""
    pairs = np.array([_BITS[i] | _BITS[j] for i, j in combinations(range(64), 2)], np.uint64)
    flips = np.concatenate([np.zeros(1, np.uint64), _BITS, pairs])
    for batch in batches:
        fp = np.asarray(batch.column(0)).view(np.uint64)
        for i in range(0, len(fp), 256):
            some = fp[i : i + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array((some[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(some, len(flips)).view(np.int64))], names=["k", "fp"]
            )


def _by_entry(entries: DataFrame) -> DataFrame:
    return entries.repartition("k").sortWithinPartitions("k")


def _searched(prints: DataFrame, bits: int, bucket: int, members: bool = False) -> DataFrame:
    """What ``_verify`` makes of the index of the distinct ``fp``."""
    entries = _by_entry(prints.mapInArrow(lambda it: _entries(it, bits), "k bigint, fp bigint"))
    return staged(entries.mapInArrow(lambda it: _verify(it, bits, bucket, members), "a bigint, b bigint, k bigint"), "links")


def _connecting(found: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints within ``bits`` bits, from what was ``_searched``."""
    links, crowd = found.filter("k IS NULL").select("a", "b").distinct(), found.filter("b IS NULL")
    if crowd.isEmpty():
        return links
    if bits > 4:
        again = crowd.select(F.col("a").alias("fp"), "k").mapInArrow(lambda it: _entries_in_crowds(it, bits), "k bigint, fp bigint")
        inside = _by_entry(again).mapInArrow(lambda it: _verify(it, bits, 1 << 62), "a bigint, b bigint, k bigint")
        return links.unionByName(inside.select("a", "b")).distinct()
    centres = crowd.select(F.col("a").alias("fp")).distinct().mapInArrow(_balls, "k bigint, fp bigint")
    hub = centres.groupBy("k").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a != top").select("k", "a")
    stars = centres.join(hub, "k").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()
    return links.unionByName(stars)


def fingerprint_links(prints: DataFrame, bits: int = DIFFERING_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly the distinct ``fp`` within ``bits`` bits."""
    return _connecting(_searched(prints, bits, bucket), bits)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, bits: int = DIFFERING_BITS, bucket: int = BUCKET) -> DataFrame:
    """One row per document: ``id_col``, ``fingerprint`` (hex), ``component_id``.

    ``component_id`` is the least id that links reach, the row's own included.
    Texts without words have fingerprint zero and link like any others; null text
    is empty text.  A null id takes part but is never a component's name unless
    all of a component's ids are null.  An empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("__id").alias("least")), "distinct")
    links = fingerprint_links(distinct.select("fp"), bits, bucket)
    groups = connected_components(links).withColumnsRenamed({"node": "fp", "component": "group"})
    members = distinct.join(groups, "fp")
    least = members.groupBy("group").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "group").select("fp", "component_id")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(named, "fp").select(
        F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _shingle_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["d", "shingles"])


def _similar(edges: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The edges ``a, b`` whose texts' shingle sets have at least that Jaccard similarity; two texts without words have."""
    nodes = edges.select(F.col("a").alias("d")).unionByName(edges.select(F.col("b").alias("d"))).distinct()
    kind = texts.schema["d"].dataType.simpleString()
    asked = texts.join(nodes, "d", "left_semi").select("d", "text")
    sets = staged(asked.mapInArrow(lambda it: _shingle_sets(it, width), f"d {kind}, shingles array<bigint>").dropDuplicates(["d"]), "shingles")
    side = lambda c: sets.select(F.col("d").alias(c), F.col("shingles").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - F.col("both")
    return edges.join(side("a"), "a").join(side("b"), "b").withColumn("both", both).filter(F.col("both") >= either * F.lit(similarity) - 1e-9).select("a", "b")


def _class_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [shingle_hashes(t.as_py(), width) for t in batch.column(1)]
        prints = np.array([simhash(h) for h in hashes], np.uint64).view(np.int64)
        sets = np.array([xxhash.xxh64_intdigest(np.unique(h).tobytes(), SEED) for h in hashes], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array(sets)], names=["d", "fp", "shingles"])


def _apart(fp: np.ndarray, label: np.ndarray, known: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within ``bits`` bits but those of one known label, some 65,536 at a time."""
    order = np.lexsort((label, known))
    fp, label, unknown = fp[order], label[order], int(np.count_nonzero(~known))
    after = np.r_[np.arange(1, unknown + 1), unknown + np.searchsorted(label[unknown:], label[unknown:], side="right")].astype(np.int64)
    left, right, n = [], [], 0
    for i, start in enumerate(after.tolist()):
        if start == len(fp):
            break
        near = np.flatnonzero(np.bitwise_count(fp[start:] ^ fp[i]) <= bits) + start
        if len(near):
            left.append(np.repeat(fp[i], len(near)))
            right.append(fp[near])
            n += len(near)
        if n >= 1 << 16:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def _apart_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) that are ``_apart`` inside each run of equal ``k`` of sorted rows ``k, fp, label``."""
    held: list[list[np.ndarray]] = []

    def ended(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, fp, label, known = (np.concatenate(c) for c in zip(*parts, strict=True))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for i, j in zip(starts, [*starts[1:], len(keys)], strict=True):
            for a, b in _apart(fp[i:j], label[i:j], known[i:j], bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).view(np.int64)), pa.array(np.maximum(a, b).view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, label = np.asarray(batch.column(0)), batch.column(2)
        columns = [keys, np.asarray(batch.column(1)).view(np.uint64), np.asarray(label.fill_null(0)), ~np.asarray(label.is_null())]
        last = int(np.searchsorted(keys, keys[-1]))
        if held and (last or held[-1][0][-1] != keys[0]):
            yield from ended([*held, [c[:last] for c in columns]])
            held = []
        elif last:
            yield from ended([[c[:last] for c in columns]])
        held.append([c[last:] for c in columns])
    if held:
        yield from ended(held)


def _copy_links(classes: DataFrame, texts: DataFrame, width: int, bits: int, similarity: float, bucket: int) -> DataFrame:
    """Links (a, b) that connect exactly the ``d`` of ``classes`` whose fingerprints are within ``bits`` bits and whose shingle sets are similar.

    First the links that connect fingerprints are verified, between the least of
    each.  Not all links need hold, so what they leave apart is then compared
    again: all pairs of classes, but those that are connected by now.
    """
    prints = staged(classes.groupBy("fp").agg(F.min("d").alias("least")), "distinct")
    found = _searched(prints.select("fp"), bits, bucket, members=True)
    links = staged(_connecting(found, bits), "connecting")
    same = classes.join(prints, "fp").filter("d != least").select(F.col("least").alias("a"), F.col("d").alias("b"))
    near = links.join(prints.select(F.col("fp").alias("a"), F.col("least").alias("u")), "a").join(prints.select(F.col("fp").alias("b"), F.col("least").alias("v")), "b")
    edges = staged(same.unionByName(near.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct(), "edges")
    sure = staged(_similar(edges, texts, width, similarity), "sure")

    groups = connected_components(sure)
    label = F.xxhash64(F.coalesce("component", "d")).alias("label")
    named = staged(classes.join(groups.withColumnRenamed("node", "d"), "d", "left").select("fp", "d", label), "named")
    known = F.when(F.min("label") == F.max("label"), F.min("label")).alias("label")
    labels = staged(named.groupBy("fp").agg(known, F.count(F.lit(1)).alias("classes")), "labels")
    listed = found.filter("k IS NOT NULL AND b IS NOT NULL").select("k", F.col("a").alias("fp"))
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp"), "k").mapInArrow(lambda it: _entries_in_crowds(it, bits), "k bigint, fp bigint")
    of_entries = _by_entry(listed.unionByName(crowded).join(labels.select("fp", "label"), "fp").select("k", "fp", "label"))
    pairs = of_entries.mapInArrow(lambda it: _apart_batches(it, bits), "a bigint, b bigint")
    several = labels.filter("classes > 1").select("fp")
    held = links.join(several, F.col("a") == F.col("fp"), "left_semi").unionByName(links.join(several, F.col("b") == F.col("fp"), "left_semi"))
    mixed = labels.filter("label IS NULL").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    pairs = pairs.unionByName(held.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).unionByName(mixed).distinct()
    side = lambda c, d: named.select(F.col("fp").alias(c), F.col("d").alias(d), F.col("label").alias(f"label_{c}"))
    left_apart = pairs.join(side("a", "u"), "a").join(side("b", "v"), "b").filter("label_a != label_b AND (a != b OR u < v)")
    rest = staged(left_apart.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), "rest").join(edges, ["a", "b"], "left_anti")
    return sure if rest.isEmpty() else sure.unionByName(_similar(rest, texts, width, similarity))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = COPY_SHINGLE, bits: int = COPY_BITS, similarity: float = COPY_SIMILARITY, bucket: int = BUCKET) -> DataFrame:
    """One row of each group of near copies, the first by id and text hash; ``docs``' columns unchanged.

    Documents link if their fingerprints differ in at most ``bits`` bits and the
    Jaccard similarity of their shingle sets is at least ``similarity``; links
    make groups.  Documents of one fingerprint and one shingle set take part once;
    all other pairs are compared but those that further links would not change.

    An id on rows of different texts is as many documents; of rows that repeat
    both id and text one stays.  Null text is empty text, and texts without words
    are copies of each other.  A null id comes after all others.  An empty table
    gives an empty result; no name of a column of ``docs`` matters.
    """
    key = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    texts = docs.select(key.alias("d"), text_or_empty(text_col).alias("text"))
    kind = texts.schema["d"].dataType.simpleString()
    rows = staged(texts.mapInArrow(lambda it: _class_batches(it, width), f"d {kind}, fp bigint, shingles bigint"), "fingerprints")
    classes = staged(rows.groupBy("fp", "shingles").agg(F.min("d").alias("d")), "classes")
    groups = connected_components(_copy_links(classes, texts, width, bits, similarity, bucket))
    gone = groups.filter("node != component").select(F.col("node").alias("first"))
    kept = staged(classes.select(F.col("d").alias("first")).join(gone, "first", "left_anti"), "kept")
    return one_row_each(docs, key, kept, rows.select("d"))
