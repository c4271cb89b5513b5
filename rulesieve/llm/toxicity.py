"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only the document has a label.  Each
sentence gets a probability from a linear model of its words; the document's is
their noisy-or, ``1 - prod(1 - p)``.  Training maximises the likelihood of the
document labels through that formula, so the blame falls on the sentences - and
words - that explain the label, and scoring locates them again.

The model is fitted on the driver on a bounded sample (``PER_CLASS`` labelled
documents of each class, whole texts, chosen by a hash of the id); every document
is scored whole where it is read, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh_names

PER_CLASS = 2000
BUCKETS = 1 << 18
#: Lengths of the beginnings that are features besides the word.
STEMS = (4, 5, 6)
#: Features that fewer sampled documents hold get no weight.
LEAST_DOCUMENTS = 8
EPOCHS = 150
RATE = 0.25
L1 = 1e-3
LIMIT = 0.7
_SENTENCE = re.compile(r"[.!?\n]+")
_STRIP = ",;:\"'()[]{}<>*#&$%@~_|-"


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence that has any."""
    found = []
    for s in _SENTENCE.split((text or "").lower()):
        if s and (words := s.split()):
            found.append(words)
    return found


def buckets(word: str) -> list[int]:
    """Features of a word: itself and its beginnings, which inflected forms share."""
    word = word.strip(_STRIP)
    parts = [word, *(f"{word[:n]}\n" for n in STEMS if len(word) > n)] if word else []
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in parts]


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]  # of buckets that have one
    bias: float
    prior: float  # the score of a document without words

    def sentence(self, words: list[str], known: dict[str, float]) -> float:
        z = self.bias + sum({w: known[w] for w in words}.values())
        return 1 / (1 + np.exp(-z)) if z > -30 else 0.0


def fit(texts: list[str], labels: list[int]) -> Model:
    """Gradient ascent on the noisy-or likelihood; one class alone gives its rate."""
    y = np.array(labels, np.float64)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if not len(y) or y.min() == y.max():
        return Model({}, -30.0 if prior <= 0.5 else 30.0, prior)
    known: dict[str, list[int]] = {}
    held = np.zeros(BUCKETS, np.int32)
    doc_of, sentence_of, feature = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        first = len(feature)
        for words in sentences(text):
            s = len(doc_of)
            doc_of.append(d)
            for w in set(words):
                if w not in known:
                    known[w] = buckets(w)
                for x in known[w]:
                    sentence_of.append(s)
                    feature.append(x)
        held[list(set(feature[first:]))] += 1
    del known
    doc, sent, feat = (np.frombuffer(x, np.int32) for x in (doc_of, sentence_of, feature))
    ids = np.flatnonzero(held >= LEAST_DOCUMENTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    use = held[feat] >= LEAST_DOCUMENTS
    feat, sent = place[feat[use]], sent[use]
    w, b = np.zeros(len(ids)), -4.0
    m, v, mb, vb = np.zeros(len(ids)), np.zeros(len(ids)), 0.0, 0.0
    balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    for t in range(1, EPOCHS + 1):
        z = b + np.bincount(sent, w[feat], minlength=len(doc))
        p = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        clean = np.bincount(doc, np.log1p(-p), minlength=len(y))  # log of the chance that no sentence offends
        whole = np.clip(-np.expm1(clean), 1e-9, 1)
        # d loglik / dz: y * p * (1 - P) / P for toxic documents, -p for clean ones
        slope = balance * np.where(y > 0, np.exp(clean) / whole, -1.0)
        g = slope[doc] * p
        gw, gb = np.bincount(feat, g[sent], minlength=len(ids)) / len(y), g.sum() / len(y)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale, scale2 = 1 - 0.9**t, 1 - 0.999**t
        step = RATE / (np.sqrt(v / scale2) + 1e-5)
        w += step * m / scale
        w = np.sign(w) * np.maximum(np.abs(w) - step * L1, 0)
        b += RATE * 0.4 * (mb / scale) / (np.sqrt(vb / scale2) + 1e-6)
    return Model({int(i): float(x) for i, x in zip(ids, w, strict=True) if x}, float(b), prior)


def _known_words(model: Model) -> type:
    weights = model.weights

    class Known(dict):
        def __missing__(self, word: str) -> float:
            if len(self) > 150_000:
                self.clear()
            x = sum(weights.get(b, 0.0) for b in buckets(word))
            if len(word) <= 64:
                self[word] = x
            return x

    return Known


@lru_cache(maxsize=2)
def _scorer(key: tuple):
    model = Model(dict(key[0]), key[1], key[2])
    known = _known_words(model)()

    def score(text: str | None) -> tuple[float, int, str | None]:
        """(noisy-or, offending sentences, the worst sentence's words)."""
        clean, worst, worst_words, offending = 0.0, 0.0, None, 0
        found = sentences(text)
        if not found:
            return model.prior if not model.weights else min(model.prior, 0.5), 0, None
        for words in found:
            p = model.sentence(words, known)
            clean += np.log1p(-min(p, 1 - 1e-12))
            offending += p >= 0.5
            if p > worst:
                worst, worst_words = p, words
        return float(-np.expm1(clean)), offending, " ".join(worst_words) if worst_words and worst >= 0.5 else None

    return score


def _score(batches: Iterator[pa.RecordBatch], key: tuple, text: str, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    score = _scorer(key)
    for batch in batches:
        made = [score(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
        columns = [
            pa.array([x[0] for x in made], pa.float64()),
            pa.array([x[1] for x in made], pa.int32()),
            pa.array([x[2] for x in made], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on ``per_class`` labelled documents of each class, or as many as there are.

    Held-out rows, null ids and labels, and null or empty texts are left out
    before the sample is drawn, by a hash of the id, ties by the id.  An id
    labelled more than once counts as toxic if any row says so; of an id's
    several texts the least is taken, once.  Without rows, or with one class
    alone, every document gets one score.  Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).filter(F.col("__text") != "")
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).filter("__id IS NOT NULL AND __y IS NOT NULL")
    known = known.groupBy("__id").agg(F.max("__y").alias("__y")).filter(~held_out("__id")).join(texts.select("__id"), "__id", "left_semi")
    order = F.xxhash64(F.lit(5), F.col("__id").cast("string"))
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("__y") == y).orderBy(order, "__id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    rows = (
        texts.join(F.broadcast(sample), "__id")  # at most 2 * per_class rows
        .groupBy("__id", "__y")
        .agg(F.min("__text").alias("__text"))
        .orderBy("__id")
        .collect()
    )
    return fit([r["__text"] for r in rows], [r["__y"] for r in rows])


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("__score", "__offending", "__worst")) -> DataFrame:
    """``docs`` with the score, the number of offending sentences and the worst of them.

    Scores look at the text alone, so repeated rows score alike.  A text without
    words scores the training rate, at most 0.5.  Null text is empty text.  An
    empty table gives an empty result.  Columns of ``docs`` that have one of the
    three ``names`` are replaced; no other name matters.
    """
    (text,) = fresh_names(docs, "text")
    rows = docs.withColumn(text, F.col(text_col).cast("string")).drop(*names)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in zip(names, (T.DoubleType(), T.IntegerType(), T.StringType()), strict=True))])
    key = (tuple(sorted(model.weights.items())), model.bias, model.prior)
    return rows.mapInArrow(lambda it: _score(it, key, text, names), schema).drop(text)
