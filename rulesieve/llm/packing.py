"""Cost-balanced packing of documents into training sequences.

Attention over a piece of ``n`` tokens costs about ``LINEAR * n + n * n``.
Documents are tokenised, cut at most where a sequence is full, and assigned in
descending order of cost to the sequence of lowest cost that still has room.

Everything happens where the text is read: a task tokenises its rows and packs
them in blocks of a bounded number of tokens, so no text or token id is
shuffled, and memory does not depend on the input.  Pieces that do not fill a
block's last sequence are carried into the next block, which leaves one padded
sequence in a task.  Sequence ids join the task's partition and a counter, so a
lost executor's task, run again, gives the same rows.
"""

from __future__ import annotations

import heapq
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 2048
LINEAR = 4096
BLOCK_TOKENS = 2_000_000
#: Entries after which a worker's word cache is cut back to its first ones, and those that stay between tasks: some 150 and 50 MB.
WORD_CACHE, WORDS_KEPT = 600_000, 200_000
#: Characters of text that are encoded together.
ENCODE_CHARS = 2_000_000
#: Longer words are encoded each time, so the cache stays small.
LONGEST_CACHED = 64

#: Beyond Latin letters, lower case may depend on context or version.
_PLAIN = re.compile("[^\x00-\u012f\u0132-\u024f]")
_STOP = re.compile(r"[.,]+(?=[ \n]|$)")

PIECES = T.StructType([
    T.StructField("start", T.LongType(), False),
    T.StructField("length", T.LongType(), False),
    T.StructField("ids_crc32", T.LongType(), False),
    T.StructField("doc_tokens", T.LongType(), False),
    T.StructField("sequence_id", T.LongType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("sequence_cost", T.DoubleType(), False),
])


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies write bytes: printable ones as they are, the rest in order from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = _byte_letters()
#: Words that tell whether the model alone gives a word's ids.
_PROBES = ("o", "the", "zzxq", "internationalisation", "\u00e9levi", "stra\u00dfe", "\u0161\u010dep", "na\u00efvet\u00e9")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


class WordEncoder:
    """Little-endian token ids of texts, encoded word by word.

    The tokenizer's pre-tokenizer never joins characters across a space or line
    feed, nor a letter or digit with punctuation after it, so a text's ids are
    its parts' ids in order.  Words are looked up in a bounded cache; those that
    are missing are encoded together, words of small Latin letters by the model
    alone.  Lower case is taken early, to share
    entries, only where it cannot change what the tokenizer sees; texts that hold
    one of the tokenizer's special strings, in whatever case, or the one letter
    whose lower case ends in a mark, go to the tokenizer whole.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has a core, and more threads only cost time
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(re.escape(x.lower()) for x in special)) if special else None
        #: What all special strings begin with, up to the first letter: texts without it need no closer look.
        self.hint = re.match(r"[\W\d_]*", os.path.commonprefix(special))[0]
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("Aa Zz \u00c9") == "aa zz \u00e9"
        self.cache: dict[str, bytes] = {"": b""}
        self.tokenize = self.tokenizer.model.tokenize
        self.direct = self.lowers and all(self._letters(w) == self._encode([w])[0] for w in _PROBES)

    def _letters(self, word: str) -> bytes:
        """Ids of a word of small Latin letters, from the model alone: nothing before it would change or cut the word."""
        if not word.isascii():
            word = word.encode("utf-8").decode("latin-1").translate(_BYTES)
        return _little(array("I", [t.id for t in self.tokenize(word)]))

    def _new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each word, the quick way where that is safe."""
        rest = []
        for w in words:
            if self.direct and w.isalpha() and w.islower() and _PLAIN.search(w) is None:
                yield w, self._letters(w)
            else:
                rest.append(w)
        yield from zip(rest, self._encode(rest), strict=True)

    def _encode(self, words: list[str]) -> list[bytes]:
        # a token id has four bytes, the lowest first
        return [_little(array("I", e.ids)) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _parts(self, text: str) -> list[str]:
        if self.lowers and _PLAIN.search(text) is None:
            text = text.lower()
        cut, last = [], 0
        for stop in _STOP.finditer(text):
            at = stop.start()
            if at and text[at - 1].isalnum():
                cut.append(text[last:at])
                last = at
        cut.append(text[last:])
        return " ".join(cut).replace("\n", " ").split(" ")

    def shrink(self) -> None:
        """Forget all but the first words seen, among which frequent ones are."""
        self.cache = dict(islice(self.cache.items(), WORDS_KEPT))

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, t in enumerate(texts) if "\u0130" in t or self.special is not None and self.hint in t and self.special.search(t.lower())}
        parts = [[] if i in whole else self._parts(t) for i, t in enumerate(texts)]
        if len(self.cache) > WORD_CACHE:
            self.shrink()
        cache = self.cache
        missing = [w for w in set().union(*parts) if w not in cache]
        cache.update(self._new(missing))
        out = [b"".join(map(cache.__getitem__, p)) for p in parts]
        for word in missing:
            if len(word) > LONGEST_CACHED:
                del cache[word]
        for i in whole:
            out[i] = self._encode([texts[i]])[0]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str | None) -> WordEncoder:
    return WordEncoder(path)


def piece_cost(length: int) -> float:
    return float(LINEAR * length + length * length)


@dataclass(slots=True)
class Piece:
    doc: int  # place of the document in its block
    start: int
    length: int


def pack_block(pieces: Iterable[Piece], capacity: int) -> list[tuple[float, list[Piece]]]:
    """Sequences of ``pieces``, as (cost, pieces), all but at most one of them full.

    Descending pieces go to the sequence of lowest cost with room; what does not
    fit there is cut off and waits its turn as a shorter piece.  There are as many
    open sequences as the pieces fill; the shortest pieces, left when all are
    full, make the last sequence.
    """
    waiting = []
    total = 0
    for p in pieces:
        total += p.length
        waiting.append((-p.length, p.doc, p.start))
    heapq.heapify(waiting)
    open_ones: list[tuple[float, int, int]] = [(0.0, i, capacity) for i in range(total // capacity)]
    made: list[list[Piece]] = [[] for _ in open_ones]
    costs = [0.0] * len(open_ones)
    while open_ones:
        negative, doc, start = heapq.heappop(waiting)
        length = -negative
        cost, i, room = heapq.heappop(open_ones)
        taken = min(length, room)
        made[i].append(Piece(doc, start, taken))
        costs[i] = cost + piece_cost(taken)
        if taken < room:
            heapq.heappush(open_ones, (costs[i], i, room - taken))
        if taken < length:
            heapq.heappush(waiting, (taken - length, doc, start + taken))
    if waiting:
        made.append([Piece(doc, start, -negative) for negative, doc, start in sorted(waiting)])
        costs.append(sum(piece_cost(p.length) for p in made[-1]))
    return list(zip(costs, made, strict=True))


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, end_id: int, capacity: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path)
    encode = encoder.ids
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << 36
    end = end_id.to_bytes(4, "little")
    block: list[tuple[object, bytes, int]] = []  # id, ids, number of ids
    pieces: list[Piece] = []
    held = 0
    made = 0

    def emit(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal block, pieces, held, made
        done = pack_block(pieces, capacity)
        left: list[Piece] = []
        columns: list[list] = [[] for _ in range(8)]
        for cost, sequence in done:
            if not last and sum(p.length for p in sequence) < capacity:
                left.extend(sequence)
                continue
            offset = 0
            for p in sequence:
                doc_id, ids, n = block[p.doc]
                crc = zlib.crc32(memoryview(ids)[4 * p.start : 4 * (p.start + p.length)])
                for column, value in zip(columns, (doc_id, p.start, p.length, crc, n, base + made, offset, cost), strict=True):
                    column.append(value)
                offset += p.length
            made += 1
        kept = {p.doc: i for i, p in enumerate({p.doc: p for p in left}.values())}
        block = [block[d] for d in kept]
        pieces = [Piece(kept[p.doc], p.start, p.length) for p in left]
        held = sum(p.length for p in pieces)
        kinds = [id_type, *[pa.int64()] * 6, pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["__id", *PIECES.fieldNames()])

    for batch in batches:
        doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        at = 0
        while at < len(doc_ids):
            upto, chars = at + 1, sizes[at]
            while upto < len(doc_ids) and chars + sizes[upto] <= ENCODE_CHARS:
                chars += sizes[upto]
                upto += 1
            some = [t or "" for t in texts.slice(at, upto - at).to_pylist()]
            for doc_id, ids in zip(doc_ids[at:upto], encode(some), strict=True):
                ids += end
                n = len(ids) // 4
                block.append((doc_id, ids, n))
                pieces.extend(Piece(len(block) - 1, s, min(capacity, n - s)) for s in range(0, n, capacity))
                held += n
                if held >= BLOCK_TOKENS:
                    yield from emit(False)
            at = upto
    if pieces:
        yield from emit(True)
    encoder.shrink()


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``id_col, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, sequence_cost``.  A document is its ids followed by
    ``end_id``; a null or empty text is that one id.  Null and repeated ids are
    packed like any other row, an empty table gives no row, and other columns of
    the input are not looked at.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    schema = T.StructType([T.StructField("__id", kind), *PIECES.fields])
    return rows.mapInArrow(lambda it: _pack(it, tokenizer, end_id, capacity, arrow_kind), schema).withColumnRenamed("__id", id_col)
