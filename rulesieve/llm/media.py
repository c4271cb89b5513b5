"""Content-defined chunking of media payloads into a deduplicated store.

A payload is cut where a rolling gear hash of its last 64 bytes has its top
bits clear, so equal stretches give equal chunks wherever they lie.  Chunks are
named by SHA-256.  The store keeps each distinct chunk once; a document keeps
the ordered list of its chunks (its manifest).  Reading back joins manifests
with the store, puts the chunks in order, and verifies every digest.

The stored form of a medium is a header (magic, payload length, number of chunks,
and the table of its chunks: length, digest), which is kept with its manifest,
and the chunks' bytes in order, which it shares with other media.

Equal texts have one manifest, and it is reassembled once, so crowds of copies
cost their ids only.  A chunk leaves a task once, however many of its rows hold
it, and by an aggregate on digests enters the store once.  Chunk bytes travel
compressed: into the store, and once more for media of several chunks; a medium
of one chunk is complete where the store's bucket lies.  Texts are cut twice,
for manifests and for the store, which costs less disk than keeping all chunks.
"""

from __future__ import annotations

import atexit
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import _shuffles_end_with_their_query, staged

UNIT = 576
MAGIC = b"RSCD"
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 2048, 65536, 13
SEGMENT = 1 << 20
LEVEL = 9
#: One 64-bit value for each byte, by rule.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([i]), 20260807) for i in range(256)], np.uint64)


def payload(text: str | None) -> bytes:
    """UTF-8 of the text, filled with bytes 255 up to a positive multiple of 576."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * ((-len(data)) % UNIT or (0 if data else UNIT))


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``."""
    n = len(data)
    if n <= MIN_CHUNK:
        return [n]
    bytes_ = np.frombuffer(data, np.uint8)
    found = []
    for at in range(0, n, SEGMENT):
        first = max(0, at - 63)
        h = GEAR[bytes_[first : at + SEGMENT]]
        for j in (1, 2, 4, 8, 16, 32):
            h[j:] += h[:-j] << np.uint64(j)
        hits = np.flatnonzero(h[at - first :] >> np.uint64(64 - CUT_BITS) == 0)
        found.append(hits + at + 1)
    places = np.concatenate(found)
    ends, last = [], 0
    while n - last > MIN_CHUNK:
        i = int(np.searchsorted(places, last + MIN_CHUNK))
        last = min(int(places[i]) if i < len(places) else n, last + MAX_CHUNK, n)
        ends.append(last)
    if not ends or ends[-1] < n:
        ends.append(n)
    return ends


def header(chunks: list[bytes], digests: list[bytes]) -> bytes:
    """What stands before a medium's chunks in its stored form."""
    table = b"".join(struct.pack("<I", len(c)) + d for c, d in zip(chunks, digests, strict=True))
    return MAGIC + struct.pack("<QI", sum(map(len, chunks)), len(chunks)) + table


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in batches:
        ids = batch.column(0)
        rows: list[list] = [[] for _ in range(8)]
        origins: list[int] = []
        held = 0

        def out(rows=rows, origins=origins, ids=ids) -> pa.RecordBatch:
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
            columns = [ids.take(pa.array(origins, pa.int64())), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))]
            return pa.RecordBatch.from_arrays(columns, names=["__id", "medium", "n_bytes", "n", "i", "digest", "length", "head", "z"])

        for place, value in enumerate(batch.column(1)):
            text = value.as_py()
            data = payload(text)
            ends = cut_points(data)
            chunks = [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
            digests = [hashlib.sha256(c).digest() for c in chunks]
            medium = hashlib.sha256(b"".join(digests)).digest()
            n_bytes = len((text or "").encode("utf-8", "surrogatepass"))
            head = header(chunks, digests)
            for i, (c, d) in enumerate(zip(chunks, digests, strict=True)):
                z = squeeze(c)
                held += len(z)
                origins.append(place)
                for column, v in zip(rows, (medium, n_bytes, len(chunks), i, d, len(c), None if i else head, z), strict=True):
                    column.append(v)
            if held >= 4 << 20:
                yield out(list(rows), list(origins))
                rows, origins, held = [[] for _ in range(8)], [], 0
        if origins:
            yield out(rows, origins)


def _payload_features(data: bytes, n_chunks: int) -> str:
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    entropy = float(-(share * np.log2(share)).sum())
    return f"chunks={n_chunks};distinct={int((counts > 0).sum())};mean={float(counts @ np.arange(256)) / len(data):.4f};entropy={entropy:.4f}"


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each medium, from its chunks in order; a wrong chunk raises."""
    names = ["medium", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    expand = zstandard.ZstdDecompressor().decompress
    chunks: list[bytes] = []
    digests: list[bytes] = []
    head = b""
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        for medium, n, i, digest, first, z in zip(*(batch.column(c) for c in ("medium", "n", "i", "digest", "head", "z")), strict=True):
            c = expand(z.as_py())
            i, n, digest = i.as_py(), n.as_py(), digest.as_py()
            head = first.as_py() if i == 0 else head
            if i != len(chunks) or hashlib.sha256(c).digest() != digest:
                raise ValueError(f"stored chunk {digest.hex()} is missing, out of order or damaged")
            chunks.append(c)
            digests.append(digest)
            if len(chunks) < n:
                continue
            data = b"".join(chunks)
            if head != header(chunks, digests):
                raise ValueError(f"the stored header of medium {medium.as_py().hex()} does not fit its chunks")
            stored = hashlib.sha256(head)
            stored.update(data)
            made = (
                medium.as_py(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]),
                len(head) + len(data), stored.hexdigest(), _payload_features(data, n),
            )
            for column, v in zip(rows, made, strict=True):
                column.append(v)
            chunks, digests = [], []
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], names=names)
    if chunks:
        raise ValueError("a stored medium lacks its last chunks")


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the chunk store; (store, manifests) as read back.

    ``store``: ``digest, z``, bucketed by digest, one row per distinct chunk; a
    table of the warehouse, which is dropped when the driver's process ends, or
    earlier by ``drop_store``.  ``manifests``: ``__id, medium, n_bytes, n, i,
    digest, length, head``, one row per chunk of a document, the header in its
    first.  Null text is empty text, which is one chunk; null and repeated ids
    are rows like any other; an empty table gives empty tables.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()
    schema = f"__id {kind}, medium binary, n_bytes bigint, n int, i int, digest binary, length int, head binary, z binary"
    cut = rows.mapInArrow(_cut, schema)
    manifests = staged(cut.drop("z"), "manifests")
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"rulesieve_chunks_{uuid.uuid4().hex}"
    once = cut.select("digest", "z").groupBy("digest").agg(F.first("z").alias("z"))
    with _shuffles_end_with_their_query(spark):
        once.write.option("compression", "none").bucketBy(n, "digest").saveAsTable(name)
    atexit.register(_drop, spark, name)
    return spark.table(name), manifests


def _drop(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session has ended
        pass


def drop_store(store: DataFrame) -> None:
    """Remove a chunk store's table and files."""
    for file in store.inputFiles()[:1]:
        _drop(store.sparkSession, file.rstrip("/").split("/")[-2])


def read_media(store: DataFrame, manifests: DataFrame) -> DataFrame:
    """One row per distinct medium: its facts, from the stored bytes read back.

    A chunk or header that is missing, damaged or out of order fails the query.
    """
    lists = manifests.select("medium", "n", "i", "digest", "head").dropDuplicates(["medium", "i"])
    found = lists.join(store, "digest", "left").select("medium", "n", "i", "digest", "head", "z")
    schema = (
        "medium binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
    single = found.filter("n = 1").mapInArrow(_reassemble, schema)
    several = found.filter("n > 1").repartition("medium").sortWithinPartitions("medium", "i").mapInArrow(_reassemble, schema)
    return single.unionByName(several)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a medium, read it back and describe it.

    Returns ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature``, one row per input row.  Null text is
    empty text; null and repeated ids are rows like any other; an empty table
    gives an empty result; other columns of the input are not looked at.
    """
    store, manifests = store_media(docs, id_col, text_col)
    facts = staged(read_media(store, manifests), "media")
    drop_store(store)
    return manifests.filter("i = 0").select("__id", "medium", "n_bytes").join(facts, "medium").select(
        F.col("__id").alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
