"""Binary token output: one concatenated id array, document boundaries in Elias-Fano form.

File format (version 2): a folder of Parquet files whose rows are *segments* in
ascending document order. A segment holds

- ``shard``, ``seq``: its place; shards are ranges of document ids,
- ``first``: ids in the shard before it,
- ``n_docs``, ``n_ids``: its documents and ids,
- ``width``, ``ids``: the ids as little-endian unsigned 16- or 32-bit integers,
- ``bounds``: the ``n_docs + 1`` boundaries, Elias-Fano coded (:func:`ef_encode`),
- ``n_null``, ``low_id``, ``high_id``, ``docs``: documents without an id (they
  come first), the smallest and the largest id, and all ids less the smallest,
  Elias-Fano coded like the boundaries.

A segment runs to about two million ids, so headers and samples are a small
part of it and a boundary takes two bits more than the logarithm of the mean
length. Offsets and ids are read by select, without decoding the rest. Parquet's
commit protocol makes the writer safe against lost executors, and the store lies
wherever Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, partitions, session
from tidemark.llm.tokens import Vocabulary, grouped

#: A segment ends with the first document that fills it to so many ids, or that is so-manieth.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 21, 1 << 17
#: Bytes of a Parquet row group: a reader holds one at a time.
ROW_GROUP = 16 << 20
#: Documents that the reader gives out at a time.
READ_DOCS = 1 << 12
#: Every so many boundaries the position of the set bit is stored, for select.
SAMPLE = 64
_MAGIC = b"EF01"
_HEADER = "<4sBxxxIQII"

STORE_SCHEMA = "shard int, seq int, first long, n_docs int, n_ids long, width int, ids binary, bounds binary, n_null int, low_id long, high_id long, docs binary"

#: Set bits of each byte, and the place of each byte's k-th set bit.
_POPCOUNT = np.array([i.bit_count() for i in range(256)], dtype=np.int64)
_PLACE = np.array([([k for k in range(8) if i >> k & 1] + [0] * 8)[:8] for i in range(256)], dtype=np.int64)


def ef_encode(values: np.ndarray) -> bytes:
    """Code a sequence of n integers that never falls, up to u, in about n * (2 + log2(u / n)) bits.

    The low ``l = floor(log2(u / n))`` bits of each value are packed; the high
    parts are unary: value i sets bit ``(v >> l) + i``. The positions of every
    ``SAMPLE``-th set bit follow, so a select reads a short stretch only.
    """
    values = np.asarray(values, dtype=np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = np.empty((n, low), dtype=np.uint8)
    for k in range(low):
        bits[:, k] = (values >> np.uint64(k)) & np.uint64(1)
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
    high[places] = 1
    low_raw, high_raw = np.packbits(bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(_HEADER, _MAGIC, low, n, top, len(low_raw), len(high_raw)) + low_raw + high_raw + samples


def ef_select(raw: bytes, index: np.ndarray | int) -> np.ndarray:
    """The values at ``index`` (one place or an array of them), as unsigned 64-bit integers.

    Each starts at the nearest stored position and walks over the set bits from
    there, a byte at a time; nothing else of the block is decoded.
    """
    magic, low, n, _, a, b = struct.unpack_from(_HEADER, raw)
    if magic != _MAGIC:
        raise ValueError("not an Elias-Fano block")
    i = np.atleast_1d(np.asarray(index, dtype=np.int64))
    if len(i) and (i.min() < 0 or i.max() >= n):
        raise IndexError("place outside the sequence")
    if not len(i):
        return np.empty(0, np.uint64)
    head = struct.calcsize(_HEADER)
    high = np.frombuffer(raw, np.uint8, b, head + a)
    at = np.frombuffer(raw, "<u4", offset=head + a + b)[i // SAMPLE].astype(np.int64)
    left, byte = i % SAMPLE, at >> 3
    word = high[byte] & (0xFF << (at & 7) & 0xFF).astype(np.uint8)
    held = _POPCOUNT[word]
    walk = np.flatnonzero(left >= held)
    while len(walk):
        left[walk] -= held[walk]
        byte[walk] += 1
        word[walk] = high[byte[walk]]
        held[walk] = _POPCOUNT[word[walk]]
        walk = walk[left[walk] >= held[walk]]
    value = (8 * byte + _PLACE[word, left] - i).astype(np.uint64) << np.uint64(low)
    if low:
        packed = np.concatenate([np.frombuffer(raw, np.uint8, a, head), np.zeros(9, np.uint8)])
        first, shift = (i * low) >> 3, ((i * low) & 7).astype(np.uint64)
        bits = np.zeros(len(i), dtype=np.uint64)
        for k in range(8):
            bits |= packed[first + k].astype(np.uint64) << np.uint64(8 * k)
        bits >>= shift
        # a ninth byte holds the rest; shifts by 64 are undefined, so it moves in two steps
        bits |= packed[first + 8].astype(np.uint64) << (np.uint64(63) - shift) << np.uint64(1)
        value |= bits & np.uint64((1 << low) - 1)
    return value


def ef_length(raw: bytes) -> int:
    """How many values a block holds."""
    return struct.unpack_from(_HEADER, raw)[2]


def ef_decode(raw: bytes) -> np.ndarray:
    """All values of an Elias-Fano block."""
    return ef_select(raw, np.arange(ef_length(raw)))


def write_token_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write the store in ascending id order.

    One range shuffle of (id, text) sorts the documents into shards; each task
    encodes its range in order and writes segments, holding one segment at a
    time. Null text counts as empty (just ``end_id``); null ids come first;
    rows that repeat an id are all written, ordered by their text's hash.
    """
    spark = session(docs)
    vocabulary = Vocabulary.ship(spark, tokenizer_path)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary.encoder()
        kind = np.dtype("<u2" if enc.vocab_size <= 1 << 16 and end_id < 1 << 16 else "<u4")
        shard, seq, first, size, count = TaskContext.get().partitionId(), 0, 0, 0, 0
        parts: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def segment() -> pa.RecordBatch:
            bounds = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])
            named = pa.concat_arrays([p[2] for p in parts])
            known = named.drop_null().to_numpy()
            row = {"shard": shard, "seq": seq, "first": first, "n_docs": count, "n_ids": size, "width": kind.itemsize, "ids": np.concatenate([p[0] for p in parts]).tobytes(), "bounds": ef_encode(bounds), "n_null": named.null_count}
            row |= {"low_id": int(known[0]) if len(known) else None, "high_id": int(known[-1]) if len(known) else None, "docs": ef_encode(known.view(np.uint64) - known[:1].view(np.uint64))}
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()), ("n_null", pa.int32()), ("low_id", pa.int64()), ("high_id", pa.int64()), ("docs", pa.binary())])
        for batch in grouped(batches):
            flat, borders = enc.encode_ended(batch.column(1), end_id)
            flat, a = flat.astype(kind), 0
            while a < batch.num_rows:
                b = int(np.searchsorted(borders, borders[a] + SEGMENT_IDS - size))
                b = max(a + 1, min(b, batch.num_rows, a + SEGMENT_DOCS - count))
                parts.append((flat[borders[a] : borders[b]].copy(), np.diff(borders[a : b + 1]), batch.column(0).slice(a, b - a)))
                size, count, a = size + int(borders[b] - borders[a]), count + b - a, b
                if size >= SEGMENT_IDS or count >= SEGMENT_DOCS:
                    yield segment()
                    seq, first, size, count, parts = seq + 1, first + size, 0, 0, []
        if parts:
            yield segment()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    placed = rows.repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    placed.mapInArrow(segments, STORE_SCHEMA).write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's segments."""
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, read back from the store.

    doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on
    request, the ids. Only one total per shard goes to the driver; the number
    of shards is a parameter of the writer, so that is bounded.
    """
    store = read_token_store(spark, path)
    session(store)
    totals = sorted((r["shard"], r["n"]) for r in store.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, before = {}, 0
    for shard, n in totals:
        base[shard], before = before, before + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = {name: batch.column(name)[row] for name in batch.schema.names}
                ids = np.frombuffer(s["ids"].as_buffer(), f"<u{s['width'].as_py()}")
                bounds_raw, before = s["bounds"].as_buffer().to_pybytes(), base[s["shard"].as_py()] + s["first"].as_py()
                docs = _doc_ids(s)
                for a in range(0, s["n_docs"].as_py(), READ_DOCS):
                    bounds = ef_select(bounds_raw, np.arange(a, min(a + READ_DOCS, s["n_docs"].as_py()) + 1)).astype(np.int64)
                    here = ids[bounds[0] : bounds[-1]].astype("<u4")
                    view, edges = memoryview(here).cast("B"), bounds - bounds[0]
                    crc = [zlib.crc32(view[4 * x : 4 * y]) for x, y in zip(edges.tolist(), edges[1:].tolist(), strict=False)]
                    cols = [docs.slice(a, len(crc)), pa.array(before + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(here, pa.int64())))
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    return store.select(*[c.split()[0] for c in STORE_SCHEMA.split(", ")]).mapInArrow(documents, schema)


def _doc_ids(segment: dict) -> pa.Array:
    """A segment's document ids, the unknown ones first."""
    nulls = pa.nulls(segment["n_null"].as_py(), pa.int64())
    if segment["low_id"].as_py() is None:
        return nulls
    known = ef_decode(segment["docs"].as_buffer().to_pybytes()) + np.array([segment["low_id"].as_py()]).view(np.uint64)
    return pa.concat_arrays([nulls, pa.array(known.view(np.int64))])


def lookup(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """Single documents by id: doc_id, ids. Only segments whose range holds an id are read.

    In a segment the id's places are found by binary search over selects, and
    two selects give the document's boundaries. An id that several rows share
    gives a row each; unknown ids give none.
    """
    wanted = sorted(set(doc_ids))
    holds = F.lit(False)
    for i in wanted:
        holds = holds | F.lit(i).between(F.col("low_id"), F.col("high_id"))
    found = read_token_store(spark, path).where(holds)
    session(found)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                s = {name: batch.column(name)[row] for name in batch.schema.names}
                ids, docs, bounds = np.frombuffer(s["ids"].as_buffer(), f"<u{s['width'].as_py()}"), s["docs"].as_buffer().to_pybytes(), s["bounds"].as_buffer().to_pybytes()
                low, nulls, n = s["low_id"].as_py(), s["n_null"].as_py(), ef_length(docs)
                for doc in wanted:
                    a, b = 0, n
                    while a < b:
                        mid = (a + b) // 2
                        a, b = (mid + 1, b) if int(ef_select(docs, mid)[0]) + low < doc else (a, mid)
                    while a < n and int(ef_select(docs, a)[0]) + low == doc:
                        x, y = ef_select(bounds, [nulls + a, nulls + a + 1]).tolist()
                        yield pa.RecordBatch.from_arrays([pa.array([doc]), pa.array([ids[x:y].tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])
                        a += 1

    return found.select("width", "ids", "bounds", "n_null", "low_id", "docs").mapInArrow(documents, "doc_id long, ids array<long>")


def new_store_path(spark: SparkSession) -> str:
    """A fresh folder for a store below the shared folder."""
    return Scratch(spark, "token-store").path("store")
