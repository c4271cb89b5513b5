"""Line deduplication by an exact set-similarity join.

A line is the set of its lower-case words.  Lines link when the Jaccard
similarity of their sets is at least ``SIMILARITY``; of linked lines all but the
first, by document and line number, are removed.  Every line with a word takes
part; only lines without one are never compared and stay.

Method: words are ordered by rarity (how often words of the same hash bucket
occur in all documents, then by hash - any total order keeps the join exact,
rare words first keep it small).  Two sets that link share a word within their
prefixes of ``n - ceil(s * n) + 1`` words, and it is among the first
``n - ceil(2 * s / (1 + s) * n) + 1`` of the set with fewer words, so only these are joined, with
filters on length, on position and on the parity of words in 128 bits, none of
which loses a link; what remains is verified on the whole sets.  Equal sets are
one class and take part once.

Reports count the links of every line, so no link is left out, however many a
crowd of near copies has.  The earliest class of a crowd that shares the least
hash of its prefix is a hub, and all classes that are similar to a hub, by the
same join, are told from it by the number ``d`` of words in which they differ.
Two classes of a hub differ in no more words than their ``d`` add up to, so where
that already makes them similar, their link is certain; such links are counted by
numbers of classes of equal ``n`` and ``d``, not pair by pair.  All other pairs are
joined.

Where lines are only removed, nobody asks for the links.  Whether a class goes
depends on one earlier match, so classes that share the least or greatest hash of
their prefixes, by either of two parts of the hashes, with a crowd are first held
against the earliest class of it.  Pairs of two classes that this settles are
then left out of the join: both go already, whatever their pairs are.

Only DataFrame and SQL functions.  What is shuffled is hashes of prefix words,
and the lines of documents while the sets of candidates are fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_names, staged, text_or_empty

SIMILARITY = 0.8
#: All lines but blank ones; a caller may ask for more.
LEAST_WORDS = 1
RARITY_BITS = 18
#: A word is one number: its level of rarity above this many bits of its hash, so that numeric order is rare first.
HASH_BITS = 55
#: Bits of a word's number by which prefixes are joined; words that agree in them are told apart when sets are verified.
KEY_BITS = 44
#: Classes with the same least or greatest hash of a prefix word from which on they are held against one of them first; no result depends on it.
CROWD = 128
#: Size of the maps that drop rows before a join, a power of two; of more rows they drop less, but never one that has a partner.
MAP_BITS = 1 << 21


def _words(line: Column) -> Column:
    """Lower-case words of a line, empty ones included."""
    odd = F.lit(False)
    for c in "\t\x0b\f\r":
        odd = odd | F.contains(line, F.lit(c))
    return F.split(F.lower(F.when(odd, F.translate(line, "\t\x0b\f\r", "    ")).otherwise(line)), " ")


def _hashed(line: Column) -> Column:
    """Hashes of the line's different words."""
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << RARITY_BITS) - 1)).cast("int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``d``, by which rows are told apart (id and text hash), and ``text``."""
    text = text_or_empty(text_col)
    return docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("d"), text.alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """``d, n_lines, line_no, line`` of every line."""
    split = keyed.select("d", F.split("text", "\n", -1).alias("lines"))
    return split.select("d", F.size("lines").cast("long").alias("n_lines"), F.posexplode("lines").alias("line_no", "line"))


def rarity_levels(keyed: DataFrame) -> list[int]:
    """For each hash bucket of words, four times log2 of its occurrences, at most 127.

    Counted over every word of every document; the result has ``2 ** RARITY_BITS``
    entries whatever the input, which come eight to a row.
    """
    lines = keyed.select(F.explode(F.split("text", "\n", -1)).alias("line"))
    counts = lines.select(F.explode(_words(F.col("line"))).alias("w")).groupBy(_bucket(F.xxhash64("w")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(127), F.floor(4 * F.log2(F.col("n") + 1))).cast("bigint")
    eight = counts.select(F.shiftright("bucket", 3).alias("k"), F.call_function("shiftleft", level, F.col("bucket").bitwiseAND(F.lit(7)) * 8).alias("bits"))
    levels = [0] * (1 << RARITY_BITS)
    for k, bits in eight.groupBy("k").agg(F.bit_or("bits")).collect():
        levels[8 * k : 8 * k + 8] = bits.to_bytes(8, "little")
    return levels


def _constant(numbers: list[int]) -> Column:
    """An array that is folded to one constant when the query is planned."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _ordered(hashed: Column, levels: list[int]) -> Column:
    """The hashes of words as numbers, rarest first."""
    table = _constant(levels)
    # arrays that cannot hold null are sorted as plain numbers
    return F.sort_array(F.transform(hashed, lambda h: F.shiftleft(F.coalesce(F.get(table, _bucket(h)), F.lit(0).cast("bigint")), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))))


def _parity(words: Column, half: int) -> Column:
    """One half of a 128-bit map: a bit is set if an odd number of words fall on it.

    The maps of two sets differ in no more bits than the sets differ in words.
    """
    bits = [0] * 128
    bits[64 * half : 64 * half + 64] = [(1 << i) - ((i == 63) << 64) for i in range(64)]
    table = _constant(bits)
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda found, w: found.bitwiseXOR(F.get(table, w.bitwiseAND(F.lit(127)).cast("int"))))


def _least_overlap(n: Column, s: float) -> Column:
    return F.ceil(n * F.lit(s) - F.lit(1e-9)).cast("int")


def line_classes(keyed: DataFrame, similarity: float, least_words: int) -> tuple[DataFrame, DataFrame]:
    """``(lines, classes)`` of all lines to compare.

    ``lines``: ``d, n_lines, line_no`` and the class's hashes ``c1, c2``.  ``classes``: the
    same hashes, a number ``k``, the ``first`` line (d, line_no), the ``size``
    in lines, the number of words ``n``, their prefix and its least hash ``m``, and the parity maps ``b1, b2``.
    """
    levels = rarity_levels(keyed)
    hashed = _lines(keyed).select("d", "n_lines", "line_no", _hashed(F.col("line")).alias("hashed"))
    worded = hashed.select("d", "n_lines", "line_no", _ordered(F.col("hashed"), levels).alias("words"))
    n = F.size("words")
    made = worded.select(
        "d", "n_lines", "line_no", n.alias("n"), F.xxhash64("words").alias("c1"), F.xxhash64(F.lit(1), "words").alias("c2"),
        F.slice("words", 1, n - _least_overlap(n, similarity) + 1).alias("prefix"), _parity(F.col("words"), 0).alias("b1"), _parity(F.col("words"), 1).alias("b2"),
    )
    # filtered only when read again: a filter before would work out the words a second time
    lines = staged(made, "lines", dictionary=False)
    classes = lines.filter(F.col("n") >= least_words).groupBy("c1", "c2").agg(F.min(F.struct("d", "line_no")).alias("first"), F.count(F.lit(1)).alias("size"), *(F.first(c).alias(c) for c in ("n", "b1", "b2", "prefix")))
    least = F.array_min(F.transform("prefix", lambda w: w.bitwiseAND(F.lit((1 << HASH_BITS) - 1))))
    classes = classes.withColumns({"k": F.monotonically_increasing_id(), "m": least})
    return lines.select("d", "n_lines", "line_no", "c1", "c2"), staged(classes, "classes", dictionary=False)


def _may_link(similarity: float) -> Column:
    """Whether classes ``x`` and ``y`` pass the filters on length and parity, with their fields as ``x.n`` and so on."""
    n, m = F.col("x.n"), F.col("y.n")
    bits = F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1"))) + F.bit_count(F.col("x.b2").bitwiseXOR(F.col("y.b2")))
    return (n >= m * similarity - 1e-9) & (m >= n * similarity - 1e-9) & (bits <= _differing(similarity))


def _differing(similarity: float) -> Column:
    """Bound of the words by which similar sets of the sizes ``x.n`` and ``y.n`` differ."""
    return (F.col("x.n") + F.col("y.n")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)


def _entries(classes: DataFrame, *more: Column) -> DataFrame:
    """``k, n, b1, b2, i, w`` of the classes' prefix words, with their positions."""
    return classes.select("k", "n", "b1", "b2", *more, F.posexplode("prefix").alias("i", "w")).withColumn("w", F.col("w").bitwiseAND(F.lit((1 << KEY_BITS) - 1)))


def _first_shared(similarity: float) -> Column:
    """Whether entries ``x`` and ``y`` are of one word, by which their classes may link.

    At the first word that two sets share, all words before it differ; where that
    already makes more differing words than the similarity allows, the match is
    not needed.
    """
    return (F.col("x.w") == F.col("y.w")) & _may_link(similarity) & (F.col("x.i") + F.col("y.i") <= _differing(similarity))


def _crowd_pairs(classes: DataFrame, similarity: float) -> DataFrame:
    """``x, y``: the earliest class of a crowd, and one of the crowd that may link to it."""
    low = lambda bits: F.transform("prefix", lambda w: w.bitwiseAND(F.lit((1 << bits) - 1)))
    ends = [f(low(bits)) for bits in (HASH_BITS, HASH_BITS // 2) for f in (F.array_min, F.array_max)]
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), x) for i, x in enumerate(ends)])).alias("m")
    crowded = classes.select(keys).groupBy("m").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CROWD).select("m")
    # the map lets a few others pass, which the count then drops
    ends = classes.select("first", "k", "n", "b1", "b2", keys).filter(_may_be_in(crowded, "m"))
    ends = staged(ends, "crowded", few_files=True)
    crowds = ends.groupBy("m").agg(F.min(F.struct("first", "k", "n", "b1", "b2")).alias("of"), F.count(F.lit(1)).alias("size"))
    leaders = crowds.filter(F.col("size") > CROWD).select("m", "of.*")
    near = leaders.alias("x").join(ends.alias("y"), (F.col("x.m") == F.col("y.m")) & (F.col("x.k") != F.col("y.k")) & _may_link(similarity))
    return near.select(F.col("x.k").alias("x"), F.col("y.k").alias("y")).distinct()


def _certain(n: Column, d: Column, m: Column, e: Column, similarity: float) -> Column:
    """Whether sets of ``n`` and ``m`` words that differ in ``d`` and ``e`` words from a third are similar, wherever they differ from it."""
    return (n + m - d - e) * F.lit(0.5) >= _needed(n + m, similarity)


def _needed(words: Column, similarity: float) -> Column:
    """Bound of the words that similar sets of so many words in all have in common."""
    return words * F.lit(similarity / (1 + similarity)) - F.lit(1e-9)


def class_hubs(keyed: DataFrame, classes: DataFrame, similarity: float) -> DataFrame | None:
    """``k, hub, d, n, first`` of the classes that are similar to a hub or are one; None without hubs."""
    crowds = staged(classes.groupBy("m").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > CROWD).select("m"), "crowds", few_files=True)
    if crowds.isEmpty():
        return None
    earliest = classes.select("m", "first", "k").join(crowds, "m").groupBy("m").agg(F.min(F.struct("first", "k")).alias("of"))
    hubs = classes.join(staged(earliest.select("of.k"), "earliest", few_files=True), "k", "left_semi")
    hubs = staged(_entries(hubs), "hubs", few_files=True)
    near = hubs.alias("x").join(_entries(classes).filter(_may_be_in(hubs, "w")).alias("y"), _first_shared(similarity))
    near = staged(near.select(F.col("x.k").alias("x"), F.col("y.k").alias("y")).distinct(), "near_hubs", few_files=True)
    sets = _word_sets(keyed, classes, near)
    # the sets of hubs are few, and each is wanted by a crowd
    centres = staged(sets.join(hubs.select("k").distinct(), "k").select(F.col("k").alias("x"), F.col("words").alias("wx")), "centres", few_files=True)
    met = near.join(sets.select(F.col("k").alias("y"), "first", F.col("words").alias("wy")), "y").join(centres, "x")
    met = met.select("x", "y", "first", F.size("wx").alias("nx"), F.size("wy").alias("n"), F.size(F.array_intersect("wx", "wy")).alias("both"))
    linked = met.filter(F.col("both") >= _needed(F.col("nx") + F.col("n"), similarity)).select("x", "y", "first", "n", (F.col("nx") + F.col("n") - 2 * F.col("both")).alias("d"))
    linked = staged(linked, "to_hubs", few_files=True)
    close = F.count_if(_certain(F.col("n"), F.col("d"), F.col("n"), F.col("d"), similarity)).alias("close")
    around = staged(linked.groupBy("x").agg(close), "around", few_files=True)
    # of several hubs the one that has most classes close to it
    best = linked.join(around, "x").groupBy("y").agg(F.max(F.struct("close", "x", "d", "n", "first")).alias("of"))
    return staged(best.select(F.col("y").alias("k"), F.col("of.x").alias("hub"), "of.d", "of.n", "of.first"), "of_hubs", few_files=True)


def _certain_links(hubs: DataFrame, similarity: float) -> DataFrame:
    """``k, gone, links`` of classes with hubs, for the links that ``_certain`` finds: counted by hub, ``n`` and ``d``."""
    cells = staged(hubs.groupBy("hub", "n", "d").agg(F.count(F.lit(1)).alias("size"), F.min("first").alias("earliest")), "cells", few_files=True)
    both = (F.col("x.hub") == F.col("y.hub")) & _certain(F.col("x.n"), F.col("x.d"), F.col("y.n"), F.col("y.d"), similarity)
    per_cell = cells.alias("x").join(cells.alias("y"), both).groupBy("x.hub", "x.n", "x.d").agg(F.sum("y.size").alias("links"), F.min("y.earliest").alias("earliest"))
    itself = _certain(F.col("n"), F.col("d"), F.col("n"), F.col("d"), similarity).cast("bigint")
    found = hubs.join(staged(per_cell, "of_cells", few_files=True), ["hub", "n", "d"])
    return found.select("k", (F.col("earliest") < F.col("first")).alias("gone"), (F.col("links") - itself).alias("links")).filter("links > 0")


def _prefix_pairs(classes: DataFrame, similarity: float, settled: DataFrame | None = None, hubs: DataFrame | None = None) -> DataFrame:
    """``x, y``, each pair once: classes that share a prefix word and pass all filters.

    Of ``settled`` classes ``y``, if given, no pair of two; of classes with
    ``hubs``, if given, no pair whose link is certain.
    """
    told = []
    if settled is not None:
        classes = classes.join(settled.withColumnRenamed("y", "k").withColumn("settled", F.lit(1)), "k", "left")
        told = [F.coalesce("settled", F.lit(0)).alias("settled")]
    if hubs is not None:
        classes = classes.join(hubs.select("k", "hub", "d"), "k", "left")
        told = [F.coalesce("hub", F.lit(-1)).alias("hub"), F.coalesce("d", F.lit(0)).alias("d")]
    entries = _entries(classes, *told).repartition("w")
    # y is the set with fewer words, or of two that have as many the one with the lesser number; filters that name
    # the partition, true of all, keep what follows behind the shuffle, so that there is one for both sides
    any_partition = F.spark_partition_id() >= 0
    early = F.col("i") <= F.col("n") - _least_overlap(F.col("n"), 2 * similarity / (1 + similarity))
    entries, of_fewer = entries.filter(any_partition), entries.filter(any_partition & early | ~any_partition)
    wanted = _first_shared(similarity) & ((F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.k") > F.col("y.k"))))
    if settled is not None:
        wanted = wanted & (F.col("x.settled") + F.col("y.settled") < 2)
    if hubs is not None:
        wanted = wanted & ((F.col("x.hub") < 0) | (F.col("x.hub") != F.col("y.hub")) | ~_certain(F.col("x.n"), F.col("x.d"), F.col("y.n"), F.col("y.d"), similarity))
    return entries.alias("x").join(of_fewer.alias("y"), wanted).select(F.col("x.k").alias("x"), F.col("y.k").alias("y")).distinct()


def _may_be_in(rows: DataFrame, *columns: str) -> Column:
    """Whether a row's values of ``columns`` may be among those of ``rows``: a map of hash bits, of one size whatever the input."""
    bit = F.xxhash64(*columns).bitwiseAND(F.lit(MAP_BITS - 1))
    words = [0] * (MAP_BITS // 64)
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b.bitwiseAND(F.lit(63)).cast("int"))
    for i, bits in rows.select(F.shiftright(bit, 6).cast("int").alias("i"), one(bit).alias("bits")).groupBy("i").agg(F.bit_or("bits")).collect():
        words[i] = bits
    return F.get(_constant(words), F.shiftright(bit, 6).cast("int")).bitwiseAND(one(bit)) != 0


def _word_sets(keyed: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``k, first, words`` of the classes in ``pairs``: the hashes of all words.

    The classes' lines are looked up in the documents by a join, before which
    maps of ``MAP_BITS`` bits drop most documents and lines that no class asks for.
    """
    asked = pairs.select(F.col("x").alias("k")).unionByName(pairs.select(F.col("y").alias("k"))).distinct()
    wanted = staged(classes.select("k", "first").join(asked, "k", "left_semi").select("k", F.col("first.d").alias("d"), F.col("first.line_no").alias("line_no")), "places", few_files=True)
    lines = _lines(keyed.filter(_may_be_in(wanted, "d"))).filter(_may_be_in(wanted, "d", "line_no"))
    sets = lines.join(wanted, ["d", "line_no"]).select("k", F.struct("d", "line_no").alias("first"), _hashed(F.col("line")).alias("words"))
    return staged(sets.dropDuplicates(["k"]), "sets")  # rows that repeat id and text hold the same line twice


def _similar(keyed: DataFrame, classes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: the pairs ``x, y`` whose whole word sets are similar, the class with the earlier first in front."""
    sets = _word_sets(keyed, classes, pairs)
    of = lambda c: sets.select(F.col("k").alias(c), F.col("first").alias(f"f{c}"), F.col("words").alias(f"w{c}"))
    least = _needed(F.size("wx") + F.size("wy"), similarity)
    found = pairs.join(of("x"), "x").join(of("y"), "y").filter(F.size(F.array_intersect("wx", "wy")) >= least)
    in_order = F.col("fx") < F.col("fy")
    return staged(found.select(F.when(in_order, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(in_order, F.col("y")).otherwise(F.col("x")).alias("b")), "links", few_files=True)


def class_verdicts(keyed: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``k, gone, links`` of the classes that link: whether an earlier class is similar, and how many classes are."""
    hubs = class_hubs(keyed, classes, similarity)
    links = _similar(keyed, classes, staged(_prefix_pairs(classes, similarity, hubs=hubs), "candidates"), similarity)
    one = F.lit(1).cast("bigint").alias("links")
    ends = links.select(F.col("a").alias("k"), F.lit(False).alias("gone"), one).unionByName(links.select(F.col("b").alias("k"), F.lit(True).alias("gone"), one))
    if hubs is not None:
        ends = ends.unionByName(_certain_links(hubs, similarity))
    return ends.groupBy("k").agg(F.max("gone").alias("gone"), F.sum("links").alias("links"))


def classes_to_remove(keyed: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``k, gone`` of the classes to which an earlier class is similar: those of ``class_verdicts``, without all links of crowds."""
    near = staged(_crowd_pairs(classes, similarity), "near_leaders")
    by_leaders = near.select(F.col("x").alias("a"), F.col("y").alias("b")) if near.isEmpty() else _similar(keyed, classes, near, similarity)
    settled = by_leaders.select(F.col("b").alias("y")).distinct()
    links = _similar(keyed, classes, staged(_prefix_pairs(classes, similarity, settled), "candidates"), similarity)
    return links.select(F.col("b").alias("k")).unionByName(settled.select(F.col("y").alias("k"))).distinct().withColumn("gone", F.lit(True))


def _of_lines(lines: DataFrame, classes: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``d, line_no, removed`` and further columns of ``verdicts``, for the lines of classes that have a verdict or several lines."""
    marked = classes.select("c1", "c2", "k", "first", "size").join(verdicts, "k", "left")
    marked = staged(marked.filter("size > 1 OR gone IS NOT NULL").drop("k", "size"), "marked", few_files=True)
    removed = F.coalesce("gone", F.lit(False)) | (F.struct("d", "line_no") != F.col("first"))
    joined = lines.filter(_may_be_in(marked, "c1")).join(marked, ["c1", "c2"])
    return joined.select("d", "line_no", removed.alias("removed"), *(c for c in verdicts.columns if c not in ("k", "gone"))).distinct()


def _verdicts(docs: DataFrame, id_col: str, text_col: str, similarity: float, least_words: int) -> tuple[DataFrame, DataFrame]:
    """All lines, and ``d, line_no, removed, links`` of those that are removed or link."""
    keyed = _keyed(docs, id_col, text_col)
    lines, classes = line_classes(keyed, similarity, least_words)
    found = _of_lines(lines, classes, class_verdicts(keyed, classes, similarity))
    return lines, found.withColumn("links", F.coalesce("links", F.lit(0))).filter("removed OR links > 0")


def line_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``d, line_no, removed, links`` of every line that is removed or links.

    ``d`` is the struct (id, hash of the text); rows that repeat both share their
    verdicts, so their lines come once.  ``links`` counts the other word sets that
    are similar to the line's, whether it is removed or stays.  Null ids and
    texts, repeated rows and empty tables are as in ``line_report``.
    """
    return _verdicts(docs, id_col, text_col, similarity, least_words)[1]


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``d, line_no`` of the lines that ``line_verdicts`` calls removed, at less work in crowds of near copies; odd rows are as there."""
    keyed = _keyed(docs, id_col, text_col)
    lines, classes = line_classes(keyed, similarity, least_words)
    return _of_lines(lines, classes, classes_to_remove(keyed, classes, similarity)).filter("removed").select("d", "line_no")


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per document: ``id_col, n_lines, n_removed, n_links, removed_lines, n_removed_links``.

    ``n_links`` sums, over the document's lines that stay, the other word sets
    that are similar to the line's (all of them are removed; each removed line has
    an earlier one that is similar or equal).  ``n_removed_links`` sums the same
    over the lines that go, so no link is left out.  ``removed_lines`` joins the
    removed line numbers, from 0, by commas.  Null text is empty text, which is one line.
    Rows that repeat both id and text get one verdict between them; a null id
    sorts first; an empty table gives an empty result; other columns of the input
    are not looked at.
    """
    lines, verdicts = _verdicts(docs, id_col, text_col, similarity, least_words)
    numbers = F.array_sort(F.collect_list(F.when(F.col("removed"), F.col("line_no"))))
    per_document = verdicts.groupBy("d").agg(
        F.count_if("removed").alias("n_removed"), F.sum(F.when(F.col("removed"), 0).otherwise(F.col("links"))).alias("n_links"),
        F.array_join(numbers.cast("array<string>"), ",").alias("removed_lines"), F.sum(F.when(F.col("removed"), F.col("links")).otherwise(0)).alias("n_removed_links"),
    )
    # every row has one line 0
    rows = lines.filter("line_no = 0").select("d", "n_lines")
    return rows.join(per_document, "d", "left").select(
        F.col("d.id").alias(id_col), "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("removed_lines", F.lit("")).alias("removed_lines"), F.coalesce("n_removed_links", F.lit(0)).alias("n_removed_links"),
    )


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with removed lines taken out of ``text_col``; all rows and columns stay.

    Documents without a removed line keep their text, null included, as it is;
    null ids, repeated rows and empty tables are as in ``line_report``, and no
    name of a column of ``docs`` matters.
    """
    key, gone_key, gone, lines = fresh_names(docs, "key", "gone_key", "gone", "lines")
    marks = removed_lines(docs, id_col, text_col, similarity, least_words).groupBy(F.col("d").alias(gone_key)).agg(F.collect_set("line_no").alias(gone))
    d = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("h"))
    numbers = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    stays = F.array_join(F.transform(numbers, lambda i: F.get(F.col(lines), i)), "\n")
    return (
        docs.withColumn(key, d).join(marks, F.col(key) == F.col(gone_key), "left")
        .withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col(text_col), "\n", -1)))
        .withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(stays))
        .select(*docs.columns)
    )
