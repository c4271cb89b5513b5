"""Secret scanning: fixed patterns plus sliding-window entropy.

Base spans come from three patterns.  Further spans come from candidate
strings, that is runs of one character class long enough for a window: a window
slides over the run, its Shannon entropy is kept up to date from the counts of
the character that enters and the one that leaves, and the stretch from the
first to the last window over the class's threshold becomes a span, unless the
allow-list knows the run or a base span already covers the stretch.

Everything is Catalyst expressions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import text_or_empty

# Kinds in reporting order, pattern, group that is measured, least length.
BASE_KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The same patterns, made to reject a text quickly if no match can pass.
_POSSIBLE = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
}
#: Patterns under which every match passes, where that gives the same spans.
_DIRECT = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}


#: Spans that are gathered or looked through together, so that their number counts less than squared.
PART = 256


@dataclass(frozen=True)
class CharacterClass:
    """Symbols of a run, the window's width and the least bits a symbol."""

    name: str
    symbols: str
    window: int
    threshold: float

    @property
    def pattern(self) -> str:
        inside = self.symbols.replace("-", "") + ("-" if "-" in self.symbols else "")
        return f"[{inside}]{{{self.window},}}"


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharacterClass("entropy_hex", DIGITS + "abcdefABCDEF", 20, 3.0),
    CharacterClass("entropy_base64", DIGITS + LOWER + UPPER + "+/_=-", 24, 4.0),
)
#: Runs that never count as secrets by entropy: words, dashed or slashed words, numbers, UUIDs, placeholders.
ALLOWED = (
    r"^[A-Z]?[a-z]+$",
    r"^[A-Z]+$",
    r"^[0-9]+$",
    r"^[A-Za-z]{1,20}(?:[-_/=+][A-Za-z]{0,20})++$",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|xxxxxxxx|abcdefghij|0123456789",
)


def _starts(text: Column, pattern: str, made) -> Column:
    """Spans of all matches of ``pattern``, as made(match, start) for each."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    spans = "array<struct<start:int,hit:string>>"

    def walk(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        grown = F.when(x["hit"].isNull(), s["last"]).otherwise(F.concat(s["last"], F.array(F.struct(start.alias("start"), x["hit"].alias("hit")))))
        full = F.size(s["last"]) >= PART
        return F.struct(
            (start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(full, F.slice(grown, PART + 1, 1)).otherwise(grown).alias("last"),
            F.when(full, F.concat(s["parts"], F.array(s["last"]))).otherwise(s["parts"]).alias("parts"),
        )

    empty = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("last"), F.array().cast(f"array<{spans}>").alias("parts"))
    pairs = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    walked = F.aggregate(pairs, empty, walk, lambda s: F.flatten(F.concat(s["parts"], F.array(s["last"]))))
    return F.transform(walked, lambda x: made(x["hit"], x["start"]))


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), end.cast("int").alias("end"))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def base_spans(text: Column, kind: int) -> Column:
    """Spans of one base kind: leftmost, non-overlapping, failing matches dropped."""
    name, pattern, group, least = BASE_KINDS[kind]
    if name in _DIRECT:
        spans = _starts(text, _DIRECT[name], lambda hit, start: _span(kind, start, start + F.length(hit)))
    else:
        spans = F.filter(
            _starts(
                text,
                pattern,
                lambda hit, start: F.when(
                    F.length(F.regexp_extract(hit, pattern, group)) >= least, _span(kind, start, start + F.length(hit))
                ),
            ),
            lambda x: x.isNotNull(),
        )
    return F.when(text.rlike(_POSSIBLE[name]), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def _hot_stretch(run: Column, cls: CharacterClass) -> Column:
    """struct(first, last) of a run's bytes: starts of the first and last window over the threshold.

    ``counts`` holds one letter per symbol, 'A' for none in the window, 'B' for
    one and so on; ``weight`` is the sum of c*log2(c) over these counts.  A step
    replaces two letters and corrects the sum by the difference.
    """
    width = cls.window
    table = F.array(*[F.lit(0.0 if c < 2 else c * log2(c)) for c in range(width + 2)])
    weight = lambda c: F.element_at(table, c + 1)
    most = width * (log2(width) - cls.threshold) + 1e-9

    def count(counts: Column, at: Column) -> Column:
        return F.ascii(F.substring(counts, at, 1)) - 65

    def put(counts: Column, at: Column, c: Column) -> Column:
        return F.overlay(counts, F.char(c + 65), at, 1)

    def place(symbol: Column) -> Column:
        return F.instr(F.lit(cls.symbols), symbol)

    def symbol(at: Column) -> Column:
        return F.substring(run, at, 1).cast("string")  # of bytes, so in constant time

    def enter(s: Column, i: Column) -> Column:
        at = place(symbol(i))
        c = count(s["counts"], at)
        return F.struct(
            put(s["counts"], at, c + 1).alias("counts"), (s["weight"] + weight(c + 1) - weight(c)).alias("weight"),
            s["first"].alias("first"), s["last"].alias("last"),
        )

    def leave(s: Column, i: Column) -> Column:
        at = place(symbol(i - width))
        c = count(s["counts"], at)
        gone = i > width
        return F.struct(
            F.when(gone, put(s["counts"], at, c - 1)).otherwise(s["counts"]).alias("counts"),
            F.when(gone, s["weight"] + weight(F.greatest(c - 1, F.lit(0))) - weight(c)).otherwise(s["weight"]).alias("weight"),
            s["first"].alias("first"), s["last"].alias("last"),
        )

    def judge(s: Column, i: Column) -> Column:
        hot = (i >= width) & (s["weight"] <= most)
        return F.struct(
            s["counts"].alias("counts"), s["weight"].alias("weight"),
            F.when(hot & (s["first"] < 0), i - width).otherwise(s["first"]).alias("first"),
            F.when(hot, i - width).otherwise(s["last"]).alias("last"),
        )

    # Three small steps a character keep each lambda short; the step's kind is its remainder.
    start = F.struct(
        F.lit("A" * len(cls.symbols)).alias("counts"), F.lit(0.0).alias("weight"), F.lit(-1).alias("first"), F.lit(-1).alias("last")
    )

    def step(s: Column, k: Column) -> Column:
        i = F.floor(k / 3).cast("int") + 1
        return F.when(k % 3 == 0, leave(s, i)).when(k % 3 == 1, enter(s, i)).otherwise(judge(s, i))

    return F.aggregate(F.sequence(F.lit(0), F.length(run) * 3 - 1), start, step, lambda s: F.struct(s["first"], s["last"]))


def entropy_spans(text: Column, cls: CharacterClass, kind: int) -> Column:
    """Spans of runs of ``cls`` whose windows reach its entropy, allow-list applied."""
    allowed = lambda hit: F.greatest(*[hit.rlike(p) for p in ALLOWED])
    runs = F.filter(
        _starts(text, cls.pattern, lambda hit, start: F.struct(hit.alias("hit"), start.alias("start"), hit.cast("binary").alias("bytes"))),
        lambda x: ~allowed(x["hit"]),
    )
    judged = F.transform(runs, lambda x: F.struct(x["start"].alias("start"), _hot_stretch(x["bytes"], cls).alias("hot")))
    hot = F.filter(judged, lambda x: x["hot"]["first"] >= 0)
    spans = F.transform(hot, lambda x: _span(kind, x["start"] + x["hot"]["first"], x["start"] + x["hot"]["last"] + cls.window))
    return F.when(text.rlike(cls.pattern), spans.cast(_SPANS)).otherwise(F.array().cast(_SPANS))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``spans`` of every row.

    Both are arrays of struct(start, kind, end), by start, then kind; kind counts
    through ``BASE_KINDS`` and then ``CLASSES``, offsets are code points, end
    exclusive.  ``spans`` holds the base spans and those that only entropy finds.
    Null text is empty text and has no span; null or repeated ids are rows like
    any other; an empty table gives an empty result; other columns of the input
    are not looked at.  The work grows with a text's length, whatever the length
    of its runs, and hardly faster with the number of its spans.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    text = F.col("__text")
    for k in range(len(BASE_KINDS)):
        rows = rows.withColumn(f"__b{k}", base_spans(text, k))
    for k, cls in enumerate(CLASSES):
        rows = rows.withColumn(f"__e{k}", entropy_spans(text, cls, len(BASE_KINDS) + k))
    base = F.concat(*[F.col(f"__b{k}") for k in range(len(BASE_KINDS))])
    more = F.concat(*[F.col(f"__e{k}") for k in range(len(CLASSES))])
    rows = rows.select("__id", F.array_sort(base).alias("base"), more.alias("more"))
    cuts = F.sequence(F.lit(0), F.floor((F.size("base") - 1) / PART).cast("int"))
    part = F.transform(cuts, lambda k: F.slice(F.col("base"), k * PART + 1, PART))
    reach = F.transform(part, lambda p: F.struct(p[0]["start"].alias("start"), F.array_max(F.transform(p, lambda b: b["end"])).alias("end"), p.alias("spans")))
    rows = rows.withColumn("parts", F.when((F.size("base") > 0) & (F.size("more") > 0), reach))
    covers = lambda b, m: (b["start"] <= m["start"]) & (b["end"] >= m["end"])
    apart = F.filter("more", lambda m: ~F.exists("parts", lambda p: covers(p, m) & F.exists(p["spans"], lambda b: covers(b, m))))
    return rows.select(
        F.col("__id").alias(id_col), "base", F.array_sort(F.concat("base", F.when(F.col("parts").isNull(), F.col("more")).otherwise(apart))).alias("spans")
    )


def spans_as_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(n) for n in [*(k[0] for k in BASE_KINDS), *(c.name for c in CLASSES)]])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )
