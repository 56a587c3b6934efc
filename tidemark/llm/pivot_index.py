"""Exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, partitions, session

#: Pivots, and vectors of the bounded sample that they are fitted on.
PIVOTS, SAMPLE = 32, 4096
#: Rings a pivot's distances are cut into, and ranges of vector length, at most: the directory has
#: PIVOTS * RINGS * SHELLS rows at most.
RINGS, SHELLS = 64, 4
#: Lengths that differ by less than this factor are one range.
SHELL_RATIO = 1.1
#: Vectors in a block of the index (a ring should fill one), and queries that visit a block together.
BLOCK, CHUNK = 512, 256
#: Rows that one step of the visit plan gives out.
VISITS = 1 << 14
#: Annuli that a query visits in each round; later rounds take all that is left. So does a round before which the
#: bounds still leave more than ``EAGER`` of all visits: then more rounds would cost more than they save.
ROUNDS, EAGER = (2, 8, 32), 0.5
#: Relative slack of the distance bounds against rounding.
SLACK = 1e-6


def quantise(vectors: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(vec_id, vector): components as floor(factor * x), x as double; rows without a whole finite vector are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(bad, F.lit(False)) & F.col(id_col).isNotNull()
    return vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * F.lit(float(factor)))).alias("vector"))


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers as little-endian 32-bit integers, or 64-bit where one needs it."""
    return x.astype("<i4" if not x.size or np.abs(x).max() < 1 << 31 else "<i8").tobytes()


def _unpack(raw: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * rows * width else "<i8").reshape(rows, width)


def _lift(x: np.ndarray, top: np.ndarray) -> np.ndarray:
    """One more component brings each vector to length ``top``: then nearest means largest inner product."""
    rest = np.sqrt(np.maximum(0.0, top**2 - (x * x).sum(axis=1)))
    return np.concatenate([x, rest[:, None]], axis=1)


def _most(gap: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The largest inner product that the triangle inequality allows within an annulus.

    ``gap``: the query's distance to the pivot, ``size``: its squared length;
    vectors lie between ``low`` and ``high`` from the pivot, lifted to ``top``.
    """
    least = np.maximum(0.0, np.maximum(low - gap, gap - high))
    return (size + top**2 - least**2) / 2 + SLACK * (top + np.sqrt(size) + 1) ** 2


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few k-means rounds, from starts that are far apart."""
    chosen = [sample[0]]
    gap = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(sample[int(gap.argmax())])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(axis=1))
    centres = np.array(chosen)
    for _ in range(5):
        near = _distances(sample, centres).argmin(axis=1)
        centres = np.array([sample[near == k].mean(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(0.0, squares))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class PivotIndex:
    """Vectors keyed by nearest pivot and distance to it, in blocks of one annulus each.

    Built over every vector; only the pivots come from a bounded sample. Equal
    vectors are one class of which the smallest ``k + 1`` ids are kept: no query
    can have more of them among its ``k`` best besides itself, so the result is
    exact and copies don't crowd a block. Vectors of very different length are
    kept in up to ``SHELLS`` ranges, each lifted to its own longest vector.
    Vectors of another width than ``width`` (default: the most frequent of the
    sample) are left out.

    ``visits`` tells, round by round, how many (query, annulus) visits the
    bounds left, and ``possible`` how many there are.
    """

    def __init__(self, vectors: DataFrame, k: int, scratch: Scratch, width: int | None = None) -> None:
        spark = session(vectors)
        self.k, self.scratch, self.spark = k, scratch, spark
        some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
        widths = [len(r["vector"]) for r in some]
        self.width = width or (max(sorted(set(widths)), key=widths.count) if widths else 0)
        self.vectors = vectors.where(F.size("vector") == self.width)
        sample = np.array([r["vector"] for r in some if len(r["vector"]) == self.width], dtype=np.float64).reshape(-1, max(1, self.width))
        norm = np.sqrt((sample * sample).sum(axis=1))
        cuts = np.unique(np.quantile(norm, np.linspace(0, 1, SHELLS + 1)[1:-1])) if len(norm) and norm.max() > SHELL_RATIO * norm.min() else np.empty(0)
        self.shells = np.square(cuts)  # edges of squared length
        length = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        shell = F.lit(0)
        for k, edge in enumerate(self.shells.tolist()):
            shell = F.when(F.col("n") >= edge, k + 1).otherwise(shell)
        tops = self.vectors.select(length.alias("n")).groupBy(shell.alias("shell")).agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("n")).collect()
        self.tops = np.zeros(len(self.shells) + 1)
        for r in tops:
            self.tops[r["shell"]] = np.sqrt(r["top"])
        self.tops[:-1] = np.maximum(self.tops[:-1], cuts)  # a length that rounding puts on the other side of an edge
        self.empty, self.visits, self.possible = not len(sample), [], 0
        if self.empty:
            return
        lifted = _lift(sample, self.tops[np.searchsorted(self.shells, norm**2, side="right")])
        self.pivots = _pivots(lifted, PIVOTS)
        spread = _distances(lifted, self.pivots).min(axis=1)
        # ring edges: distance quantiles of the sample, the same for all pivots; the last ring is open
        rings = int(min(RINGS, max(1, sum(r["n"] for r in tops) // (PIVOTS * BLOCK))))
        self.edges = np.unique(np.quantile(spread, np.linspace(0, 1, rings + 1)[1:-1]))
        self.blocks = scratch.put(self._blocks(), "blocks")
        rows = self.blocks.groupBy("pivot", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).orderBy("pivot", "ring").collect()
        self.directory = np.array([[r["pivot"], r["ring"], r["low"], r["high"], r["n"]] for r in rows], dtype=np.float64)

    def _blocks(self) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
        classes = self.vectors.withColumn("rank", rank).where(F.col("rank") <= self.k + 1).select("vec_id", "vector")
        width, tops, shells, pivots, edges = self.width, self.tops, self.shells, self.pivots, self.edges

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), width).astype(np.float64)
                shell = np.searchsorted(shells, (x * x).sum(axis=1), side="right")
                gaps = _distances(_lift(x, tops[shell]), pivots)
                near = gaps.argmin(axis=1)
                dist = gaps[np.arange(len(near)), near]
                ring = shell * RINGS + np.searchsorted(edges, dist, side="right")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(ring, pa.int32()), pa.array(dist)], names=["vec_id", "vector", "pivot", "ring", "distance"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows(held: dict) -> Iterator[pa.RecordBatch]:
                (pivot, ring), ids, xs, dist = held["key"], np.concatenate(held["ids"]), np.concatenate(held["x"]), np.concatenate(held["d"])
                out = []
                for a in range(0, len(ids), BLOCK):
                    b = slice(a, a + BLOCK)
                    out.append({"pivot": pivot, "ring": ring, "low": float(dist[b].min()), "high": float(dist[b].max()), "n": len(ids[b]), "ids": ids[b].astype("<i8").tobytes(), "x": _pack(xs[b])})
                yield pa.RecordBatch.from_pylist(out, schema)

            schema = pa.schema([("pivot", pa.int32()), ("ring", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())])
            held: dict | None = None
            for batch in batches:
                keys = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy()], axis=1)
                cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
                ids, x, dist = batch.column(0).to_numpy(), _matrix(batch.column(1), width) if batch.num_rows else None, batch.column(4).to_numpy()
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if held and (held["key"] != tuple(keys[a].tolist()) or held["n"] >= BLOCK):
                        yield from rows(held)
                        held = None
                    held = held or {"key": tuple(keys[a].tolist()), "n": 0, "ids": [], "x": [], "d": []}
                    held["n"] += b - a
                    for name, part in (("ids", ids[a:b]), ("x", x[a:b]), ("d", dist[a:b])):
                        held[name].append(part)
            if held:
                yield from rows(held)

        keyed = classes.mapInArrow(key, "vec_id long, vector array<long>, pivot int, ring int, distance double")
        placed = keyed.repartitionByRange(partitions(self.spark), "pivot", "ring", "distance", "vec_id").sortWithinPartitions("pivot", "ring", "distance", "vec_id")
        return placed.mapInArrow(pack, "pivot int, ring int, low double, high double, n int, ids binary, x binary")

    def _caps(self, x: np.ndarray) -> np.ndarray:
        """For queries, the largest score that each annulus of the directory allows."""
        pivot, ring, low, high = (self.directory[:, k] for k in range(4))
        gap = _distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), self.pivots)[:, pivot.astype(int)]
        return _most(gap, (x * x).sum(axis=1)[:, None], low, high, self.tops[ring.astype(int) // RINGS])

    def _left(self, state: DataFrame, seen: int) -> int:
        """Visits that the bounds leave beyond the first ``seen`` annuli of each query."""
        width, caps = self.width, self._plain()._caps

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cap = -np.sort(-caps(_matrix(batch.column(0), width).astype(np.float64)), axis=1)[:, seen:]
                    floor = np.array([-np.inf if v is None else v for v in batch.column(1).to_pylist()])
                    yield pa.RecordBatch.from_arrays([pa.array([int((cap >= floor[:, None]).sum())])], names=["n"])

        return state.select("vector", "floor").mapInArrow(count, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0

    def _plain(self) -> PivotIndex:
        """The index's arrays without its session, to travel with tasks."""
        bare = object.__new__(PivotIndex)
        bare.directory, bare.pivots, bare.tops = self.directory, self.pivots, self.tops
        return bare

    def _visits(self, state: DataFrame, seen: int, upto: int | None) -> DataFrame:
        """The queries that must still visit each annulus, in chunks: pivot, ring, queries, xs, floors.

        A query's annuli are sorted by the largest score that the triangle
        inequality leaves them; this gives places ``seen`` to ``upto`` of that
        order, down to the query's k-th best score.
        """
        width, directory, caps = self.width, self.directory, self._plain()._caps

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), width).astype(np.float64)
                floor = np.array([-np.inf if v is None else v for v in batch.column(2).to_pylist()])
                cap = caps(x)
                order = np.argsort(-cap, axis=1, kind="stable")[:, seen:upto]
                packed = pa.array([_pack(v) for v in _matrix(batch.column(1), width)], pa.binary())
                some = max(1, VISITS // max(1, order.shape[1]))
                for a in range(0, len(x), some):
                    row = np.repeat(np.arange(a, min(a + some, len(x))), order.shape[1])
                    cell = order[a : a + some].ravel()
                    keep = cap[row, cell] >= floor[row]
                    row, cell = row[keep], cell[keep]
                    take = pa.array(row, pa.int64())
                    place = [pa.array(directory[cell, k].astype(np.int32)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*place, batch.column(0).take(take), packed.take(take), batch.column(2).take(take)], names=["pivot", "ring", "query_id", "x", "floor"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def chunk(rows: list[tuple]) -> dict:
                (pivot, ring), raws = rows[0][0], [r[2] for r in rows]
                xs = b"".join(raws) if len({len(raw) for raw in raws}) == 1 else _pack(np.concatenate([_unpack(raw, 1, width) for raw in raws]))
                return {"pivot": pivot, "ring": ring, "queries": np.array([r[1] for r in rows], "<i8").tobytes(), "xs": xs, "floors": np.array([-(1 << 63) if r[3] is None else r[3] for r in rows], "<i8").tobytes()}

            schema = pa.schema([("pivot", pa.int32()), ("ring", pa.int32()), ("queries", pa.binary()), ("xs", pa.binary()), ("floors", pa.binary())])
            held: list[tuple] = []
            for batch in batches:
                out = []
                for pivot, ring, query, x, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if held and (held[0][0] != (pivot, ring) or len(held) >= CHUNK):
                        out.append(chunk(held))
                        held = []
                    held.append(((pivot, ring), query, x, floor))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)
            if held:
                yield pa.RecordBatch.from_pylist([chunk(held)], schema)

        planned = state.select("query_id", "vector", "floor").mapInArrow(plan, "pivot int, ring int, query_id long, x binary, floor long")
        dealt = planned.repartitionByRange(partitions(self.spark), "pivot", "ring", "query_id").sortWithinPartitions("pivot", "ring", "query_id")
        return dealt.mapInArrow(gather, "pivot int, ring int, queries binary, xs binary, floors binary")

    def _scores(self, visits: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best of each block that reach the query's floor."""
        k, width, pivots, tops = self.k, self.width, self.pivots, self.tops

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x, queries, xs, floors, pivot, ring, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    ids, queries, floors = (np.frombuffer(raw, "<i8") for raw in (ids, queries, floors))
                    x, xs = _unpack(x, len(ids), width).astype(np.int64), _unpack(xs, len(queries), width).astype(np.int64)
                    # the block's own annulus is narrower than its ring's
                    lifted = np.concatenate([xs.astype(np.float64), np.zeros((len(xs), 1))], axis=1)
                    keep = _most(_distances(lifted, pivots[pivot : pivot + 1])[:, 0], (lifted * lifted).sum(axis=1), low, high, tops[ring // RINGS]) >= floors
                    if not keep.any():
                        continue
                    queries, floors, xs = queries[keep], floors[keep], xs[keep]
                    largest = float(np.abs(x).max()) * float(np.abs(xs).max()) * width
                    # doubles hold the products and their sums exactly below 2**53
                    all_ = (xs.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if largest < 2**53 else xs @ x.T
                    all_[queries[:, None] == ids[None, :]] = -(1 << 63)
                    least = floors
                    if len(ids) > k:
                        least = np.maximum(floors, np.partition(all_, len(ids) - k, axis=1)[:, len(ids) - k])
                    row, col = np.nonzero((all_ >= least[:, None]) & (all_ > -(1 << 63)))
                    yield pa.RecordBatch.from_arrays([pa.array(queries[row]), pa.array(ids[col]), pa.array(all_[row, col])], names=["query_id", "vec_id", "score"])

        paired = self.blocks.join(visits, ["pivot", "ring"]).select("ids", "x", "queries", "xs", "floors", "pivot", "ring", "low", "high")
        return paired.mapInArrow(score, "query_id long, vec_id long, score long")

    def search(self, queries: DataFrame) -> DataFrame:
        """The ``k`` best of every query (vec_id, vector): query_id, rank, vec_id, score.

        Annuli are expanded round by round in the order of their bounds; a query
        stops when no annulus left allows its k-th best score. Ties go to the smaller id; fewer candidates than
        ``k`` are all returned. A query doesn't find its own id. Queries of
        another width find nothing.
        """
        schema = "query_id long, rank int, vec_id long, score long"
        if self.empty:
            return self.spark.createDataFrame([], schema)
        asked = self.scratch.put(queries.where(F.size("vector") == self.width).select(F.col("vec_id").alias("query_id"), "vector").dropDuplicates(["query_id"]), "queries")
        best, seen = None, 0
        self.possible, self.visits = asked.count() * len(self.directory), []
        for n, more in enumerate([*ROUNDS, None]):
            upto = None if more is None else seen + more
            if best is None:
                state = asked.withColumn("floor", F.lit(None).cast("long"))
            else:
                floors = best.where(F.col("rank") == self.k).select("query_id", F.col("score").alias("floor"))
                state = asked.join(floors, "query_id", "left")
                self.visits.append(self._left(state, seen))
                if not self.visits[-1]:
                    break
                if self.visits[-1] > EAGER * self.possible:
                    upto = None
            visits = self.scratch.put(self._visits(state, seen, upto), f"visits-{n}")
            if best is None and visits.isEmpty():
                break
            found = self._scores(visits)
            if best is not None:
                found = found.unionByName(best.select("query_id", "vec_id", "score"))
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            best = self.scratch.put(found.withColumn("rank", rank).where(F.col("rank") <= self.k).select("query_id", F.col("rank").cast("int"), "vec_id", "score"), f"best-{n}")
            self.scratch.drop(f"visits-{n}", f"best-{n - 1}")
            seen = upto if upto is not None else len(self.directory)
            if seen >= len(self.directory):
                break
        return best if best is not None else self.spark.createDataFrame([], schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact top-``k`` of ``queries`` (rows of the same columns) against all ``vectors``.

    Rows with a null id, or whose vector is null, empty or holds null or
    non-finite components, take no part. Rows that repeat an id and a vector
    count once; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "pivot-index")
    clean = scratch.put(quantise(vectors, id_col, vector_col, factor).distinct(), "vectors")
    return PivotIndex(clean, k, scratch).search(quantise(queries, id_col, vector_col, factor))
