"""Language-model scores from a subword lattice over corpus counts.

The pieces of an existing vocabulary, by its own scores, weight all segmentations
of a word; a forward recursion sums them, so ``q(word)`` is a marginal probability
and not that of one segmentation.  Single bytes stand in for characters without
a piece, so every word has one.  What the training documents teach are whole
words, a further arc over each: a token of training count ``c`` has probability

    (c + V * q(token)) / (N + V)

with ``N`` training tokens, ``V`` of them different (Witten and Bell's estimate).
A text's score is the sum of the logarithms, the end included, hence the
probability of texts is at most one in total.

Words of all documents are counted once, each different word is put through the
lattice once, and the values go back to the texts: those of the most frequent
words, at most ``HOT``, are broadcast; the rest of a document's words leave its
task as (row, word, n) and meet their values in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import staged

HOT = 300_000
PARTIAL_WORDS = 200_000
#: Words of a lower probability are scored in logarithms.
LEAST_CHANCE = 1e-200
MARK = "▁"
_LOG10 = math.log(10)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered: runs without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


@lru_cache(maxsize=1)
def vocabulary(path: str | None) -> tuple[list[str], list[float]]:
    """Pieces and their log probabilities.

    A unigram vocabulary's scores are log probabilities.  A merge vocabulary
    scores a piece by the negative of its rank r, which stands for Zipf's
    1 / (r + 2.7).  Bytes and the end have the least of all.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or default_vocabulary())
    names, weights = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece, score = model.id_to_piece(i), model.get_score(i)
        if piece == MARK:
            score = max(score, -float(model.get_piece_size()))
        if score < -1e8 or MARK in piece[1:]:
            continue
        names.append(piece)
        weights.append(1 / (2.7 - score) if score <= 0 else math.exp(score))
    least = min(weights)
    names += [f"<0x{b:02X}>" for b in range(256)] + ["</s>"]
    weights += [least] * 257
    total = math.log(sum(weights))
    return names, [math.log(w) - total for w in weights]


class Lattice:
    """Forward recursion over all segmentations of a word."""

    def __init__(self, names: list[str], logs: list[float]):
        special = len(names) - 257
        self.index = {n: i for i, n in enumerate(names[:special])}
        self.logs = logs
        self.byte = list(range(special, special + 256))
        self.end = special + 256
        self.pieces = {n: (i, logs[i]) for n, i in self.index.items()}
        #: Every beginning of a piece, with the piece it is, if it is one.
        self.begins: dict[str, tuple[int, float] | None] = {n[:k]: None for n in self.pieces for k in range(1, len(n))} | self.pieces
        self.letters: dict[str, float] = {}
        #: The same as plain probabilities, which serve most words.
        self.chances = {n: hit and (hit[0], math.exp(hit[1])) for n, hit in self.begins.items()}
        self.letter_chances: dict[str, tuple[tuple[int, ...], float]] = {}

    def log_probability(self, word: str) -> float:
        """Natural log of the summed probability of the word's segmentations."""
        marked = MARK + word
        size = len(marked)
        begins, letters = self.chances, self.letter_chances
        forward = [1.0] + [0.0] * size
        for i in range(size):
            here = forward[i]
            if not here:
                continue  # no segmentation ends here
            for j in range(i + 1, size + 1):
                hit = begins.get(marked[i:j], False)
                if hit is False:
                    break
                if hit is not None:
                    forward[j] += here * hit[1]
            if i:
                letter = letters.get(marked[i])
                if letter is None:
                    letter = self._letter(marked[i])
                forward[i + 1] += here * letter[1]
        return math.log(forward[size]) if forward[size] >= LEAST_CHANCE else self._log_probability_logs(word)

    def _letter(self, c: str) -> tuple[tuple[int, ...], float]:
        """The bytes of a character and their probability, kept for the next time."""
        ids = tuple(self.byte[b] for b in c.encode("utf-8", "surrogatepass"))
        found = self.letter_chances[c] = ids, math.exp(sum(self.logs[x] for x in ids))
        return found

    def _log_probability_logs(self, word: str) -> float:
        marked = MARK + word
        n = len(marked)
        begins, letters, exp, log = self.begins, self.letters, math.exp, math.log
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        here = 0.0
        for i in range(n):
            if i:
                at = terms[i]
                if not at:
                    continue  # no segmentation ends here
                top = max(at)
                here = top + log(sum([exp(t - top) for t in at])) if len(at) > 1 else top
                c = marked[i]
                lp = letters.get(c)
                if lp is None:
                    lp = letters[c] = sum(self.logs[self.byte[b]] for b in c.encode("utf-8", "surrogatepass"))
                terms[i + 1].append(here + lp)
            for j in range(i + 1, n + 1):
                hit = begins.get(marked[i:j], False)
                if hit is False:
                    break
                if hit is not None:
                    terms[j].append(here + hit[1])
        at = terms[n]
        top = max(at)
        return top + log(sum([exp(t - top) for t in at]))


@lru_cache(maxsize=2)
def lattice_of(path: str | None) -> Lattice:
    return Lattice(*vocabulary(path))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, c) of the rows, in parts of bounded size: occurrences, and those in training rows; the end is a line feed."""
    every: Counter = Counter()
    training: Counter = Counter()

    def out() -> pa.RecordBatch:
        words = list(every)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(every.values()), pa.int64()), pa.array([training[w] for w in words], pa.int64())], names=["word", "n", "c"])

    for batch in batches:
        for text, held in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            words = Counter(words_of(text.as_py()))
            words[b"\n"] += 1
            every.update(words)
            if not held:
                training.update(words)
            if len(every) > PARTIAL_WORDS:
                yield out()
                every.clear()
                training.clear()
    if every:
        yield out()


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``word``, ``n``, ``c``) over all documents, the end symbol included; ``c`` counts training documents only."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"), held_out(id_col).alias("held"))
    return texts.mapInArrow(_count, "word binary, n bigint, c bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def _weigh(batches: Iterator[pa.RecordBatch], path: str | None, total: int, distinct: int) -> Iterator[pa.RecordBatch]:
    """For each different word its base value and score, in log10."""
    lattice = lattice_of(path)
    denominator, tokens = float(total + distinct + 1), float(total + distinct)
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        scores = []
        for word, c in zip(words, counts, strict=True):
            lq = lattice.logs[lattice.end] if word == b"\n" else lattice.log_probability(word.decode("utf-8", "surrogatepass"))
            if c:
                scores.append(math.log10((c + distinct * math.exp(lq)) / tokens))
            else:  # without a training document nothing but the lattice is known
                scores.append(lq / _LOG10 + (math.log10(distinct / tokens) if distinct else 0.0))
        base = [math.log10((c + 1) / denominator) for c in counts]
        columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(base, pa.float64()), pa.array(scores, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "c", "base", "score"])


def word_values(counts: DataFrame, total: int, distinct: int, path: str | None = None) -> DataFrame:
    """``word, n, c, base, score`` of every different word."""
    return counts.mapInArrow(lambda it: _weigh(it, path, total, distinct), "word binary, n bigint, c bigint, base double, score double")


def _score(batches: Iterator[pa.RecordBatch], hot) -> Iterator[pa.RecordBatch]:
    """A row of sums for each text, and rows (word, n) of its words that are not hot."""
    known = hot.value
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 36
    seen = 0
    names = ["row", "id", "word", "n", "n_tokens", "n_known", "base", "score"]

    def out(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        size = len(columns["row"])
        return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[n]) if n in columns else pa.nulls(size, kinds[n]) for n in names], names=names)

    for batch in batches:
        kinds = dict(zip(names, [pa.int64(), batch.schema.field(0).type, pa.binary(), *[pa.int64()] * 3, pa.float64(), pa.float64()], strict=True))
        for at in range(0, batch.num_rows, 1000):
            some = batch.slice(at, 1000)
            whole: dict[str, list] = {n: [] for n in ("row", "n_tokens", "n_known", "base", "score")}
            rest: dict[str, list] = {n: [] for n in ("row", "word", "n")}
            for text in some.column(1):
                words = words_of(text.as_py())
                row = base + seen
                seen += 1
                n_known, total, score = 0, 0.0, 0.0
                words.append(b"\n")
                for word, n in Counter(words).items():
                    values = known.get(word)
                    if values is None:
                        rest["row"].append(row)
                        rest["word"].append(word)
                        rest["n"].append(n)
                    else:
                        n_known += n * values[0]
                        total += n * values[1]
                        score += n * values[2]
                for name, v in (("row", row), ("n_tokens", len(words)), ("n_known", n_known), ("base", total), ("score", score)):
                    whole[name].append(v)
            yield out(whole | {"id": some.column(0).to_pylist()}, kinds)
            if rest["row"]:
                yield out(rest, kinds)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, hot_words: int = HOT) -> DataFrame:
    """Score all documents under the words of the training ones and the vocabulary's pieces.

    Returns ``id_col, held_out, n_tokens, n_known, train_tokens, base_score,
    score``, one row per input row.  Null text is empty text: one token, the end.
    A null id trains; repeated ids are rows like any other; an empty table gives
    an empty result; other columns of the input are not looked at.
    """
    spark = docs.sparkSession
    counts = staged(word_counts(docs, id_col, text_col), "word_counts")
    thresholds = [2**i for i in range(45)]
    facts = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("N"), F.count_if(F.col("c") > 0).alias("V"),
        *[F.count_if(F.col("n") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)],
    ).first()
    total, distinct = facts["N"], facts["V"]
    least = next(t for i, t in enumerate(thresholds) if facts[f"t{i}"] <= hot_words)
    values = staged(word_values(counts, total, distinct, vocabulary_path), "word_values")
    frequent = values.filter(F.col("n") >= least).select("word", (F.col("c") > 0).cast("int").alias("known"), "base", "score").toArrow()  # at most hot_words rows
    hot = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), zip(*(frequent[c].to_pylist() for c in ("known", "base", "score")), strict=True), strict=True)))
    del frequent
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, word binary, n bigint, n_tokens bigint, n_known bigint, base double, score double"
    made = staged(texts.mapInArrow(lambda it: _score(it, hot), schema), "scored")
    rare = values.filter(F.col("n") < least).select("word", "c", F.col("base").alias("b"), F.col("score").alias("s"))
    more = made.filter("word IS NOT NULL").select("row", "word", "n").join(rare, "word").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.col("b")).alias("more_base"), F.sum(F.col("n") * F.col("s")).alias("more_score"),
    )
    whole = made.filter("word IS NULL").drop("word", "n").join(more, "row", "left")
    plus = lambda c, more, zero: F.col(c) + F.coalesce(more, F.lit(zero))
    return whole.select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", plus("n_known", "more_known", 0).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), plus("base", "more_base", 0.0).alias("base_score"), plus("score", "more_score", 0.0).alias("score"),
    )
