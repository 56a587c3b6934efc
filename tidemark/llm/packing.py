"""Best-fit packing with large-item matching, planned on the histogram of lengths."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, session
from tidemark.llm.tokens import Vocabulary, grouped

#: Parts that a length class is ranked in; the largest class is spread over all of them.
RANK_PARTS = 256


def piece_table(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut only documents longer than ``capacity`` ids.

    The first piece takes the remainder, the others are full. Null text counts
    as empty (one piece that holds just ``end_id``); null ids are carried along.
    Returns doc_id, piece, start, length, ids_crc32.
    """
    vocabulary = Vocabulary.ship(session(docs), tokenizer_path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = vocabulary.encoder()
        for batch in grouped(batches):
            ids, borders = enc.encode_ended(batch.column(1), end_id)
            raw = memoryview(ids).cast("B")
            rows: list[tuple] = []
            for doc, at, n in zip(batch.column(0).to_pylist(), borders.tolist(), np.diff(borders).tolist(), strict=False):
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * (at + a) : 4 * (at + b)])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


@dataclass
class Pattern:
    """``count`` sequences that hold the same lengths, in this order."""

    count: int
    lengths: list[int] = field(default_factory=list)


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Pack a histogram of lengths into patterns of at most ``capacity``.

    Lengths above a third of the capacity are matched greedily: the longest
    left takes the longest partner that fits, so at most two share a sequence.
    The rest go, longest first, into the smallest gap that holds them (best
    fit); what fits no gap opens sequences. All steps work on counts, so the
    cost depends on the number of distinct lengths only.
    """
    left = {n: c for n, c in histogram.items() if c > 0 and n <= capacity}
    large = sorted(n for n in left if 3 * n > capacity)
    small = sorted((n for n in left if 3 * n <= capacity), reverse=True)
    open_: dict[int, list[Pattern]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern: Pattern) -> None:
        if not pattern.count:
            return
        if gap not in open_:
            open_[gap] = []
            bisect.insort(gaps, gap)
        open_[gap].append(pattern)

    while large:
        top = large[-1]
        at = bisect.bisect_right(large, capacity - top) - 1
        if at >= 0 and large[at] == top and left[top] == 1:
            at -= 1
        if at < 0:
            put(capacity - top, Pattern(left[top], [top]))
            left[top] = 0
        else:
            mate = large[at]
            n = left[top] // 2 if mate == top else min(left[top], left[mate])
            put(capacity - top - mate, Pattern(n, [top, mate]))
            left[top] -= n
            left[mate] -= n
        large = [n for n in large if left[n]]
    for size in small:
        todo = left[size]
        while todo:
            at = bisect.bisect_left(gaps, size) if size else len(gaps)
            if at == len(gaps):
                each = capacity // size if size else todo
                put(capacity - each * size, Pattern(todo // each, [size] * each))
                put(capacity - todo % each * size, Pattern(int(todo % each > 0), [size] * (todo % each)))
                break
            gap = gaps[at]
            pattern = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            each = gap // size
            full = min(pattern.count, todo // each)
            part = todo % each if full < pattern.count else 0
            used = full + (part > 0)
            put(gap - each * size, Pattern(full, pattern.lengths + [size] * each))
            put(gap - part * size, Pattern(int(part > 0), pattern.lengths + [size] * part))
            todo -= full * each + part
            put(gap, Pattern(pattern.count - used, pattern.lengths))
    return [p for ps in open_.values() for p in ps]


def slot_arrays(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank of each slot range, its first sequence, its offset."""
    taken: dict[int, int] = {}
    slots: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for p in patterns:
        offset = 0
        for n in p.lengths:
            slots.setdefault(n, []).append((taken.get(n, 0), base, offset))
            taken[n] = taken.get(n, 0) + p.count
            offset += n
        base += p.count
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) for n, rows in slots.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids.

    1. One pass tokenises and cuts (no shuffle); the narrow piece table is
       written. 2. The histogram of lengths (at most ``capacity`` rows, so
       bounded at any input size) goes to the driver, which plans patterns.
    3. Every piece gets a rank within its length: ranks run inside
       ``RANK_PARTS`` hashed parts of a length, after an offset from the parts'
       counts, so that a length that a third of the pieces share is no single
       task. 4. (length, rank) gives the sequence and the offset by binary
       search in the plan.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. Nothing is dropped; rows that repeat an id give pieces
    of their own; an empty table gives an empty result.
    """
    spark = session(docs)
    scratch = Scratch(spark, "pack")
    pieces = scratch.put(piece_table(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = slot_arrays(plan_patterns(histogram, capacity))

    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)).cast("int").alias("part")
    parted = pieces.select("*", part)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = parted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("first")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, base, where = slots[n]
                # slots of no sequences don't occur, so first ranks strictly rise
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = base[k] + rank[at] - first[k], where[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
