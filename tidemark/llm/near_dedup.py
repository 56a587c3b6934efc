"""Near-duplicate classes of documents by HyperMinHash, with exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, fresh, partitions, session, trim
from tidemark.llm.components import connected_components

#: Registers of a sketch, and registers per band: four 16-bit registers are one 64-bit band value.
REGISTERS, BAND_REGISTERS = 128, 4
BANDS = REGISTERS // BAND_REGISTERS
#: Mantissa bits a register keeps behind its leading-zero count.
MANTISSA = 10
#: Standard errors that an estimate may lie below the threshold before a pair is dropped unverified.
SLACK = 5.0
#: Ids that are broadcast at most (8 bytes each); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Buckets that are broadcast at most (28 bytes each); beyond it the join shuffles.
BROADCAST_BUCKETS = 500_000
#: Documents, and bytes of their shingle sets, that one block of the remainder holds on average.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Components of a split bucket whose best-placed member is tried as a hub.
CENTRES = 4
#: A shingle that more than this part of a group holds counts as common there: its count goes to every member.
COMMON = 16
#: Lists that a member of a whole group is put on for, on average, at most; deeper, no more than it has blocks to meet.
FAN = 32
#: Shingles whose places among the members are multiplied at a time.
STRIP = 2048
#: Bytes of text hashed at a time.
SLAB = 1 << 20

_U = np.uint64
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _stream(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers."""
    return np.random.Generator(np.random.Philox(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


_BYTES = _stream(1, 256)
_BYTES[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_BASE, _PLACES, _MULTIPLIERS = _stream(2, 1)[0], _stream(3, 64), _stream(4, REGISTERS)
_powers = np.cumprod(np.full(256, _BASE), dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hash_slab(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    inside = _WORD[buf]
    if not inside.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    length = ends - starts
    while len(_powers) < length.max():
        _powers = np.concatenate([_powers, _powers * _powers[-1]])
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    return _mix(np.add.reduceat(_BYTES[buf[inside]] * _powers[place], first)), starts


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, and where they start."""
    buf = np.frombuffer(raw, np.uint8)
    if len(buf) <= 2 * SLAB:
        return _hash_slab(buf)
    hashes, places, at = [], [], 0
    while at < len(buf):
        end = min(at + SLAB, len(buf))
        while end < len(buf) and _WORD[buf[end]]:  # up to the next white space
            gap = np.flatnonzero(~_WORD[buf[end : end + SLAB]])
            end = min(end + (int(gap[0]) if len(gap) else SLAB), len(buf))
        h, s = _hash_slab(buf[at:end])
        hashes.append(h)
        places.append(s + at)
        at = end
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes.

    Fewer than ``width`` words make one shingle of the whole sequence; no words
    or null make the empty set.
    """
    out: list[np.ndarray] = []
    raws = [(t or "").encode() for t in texts]
    at = 0
    while at < len(raws):
        end, size = at + 1, len(raws[at])
        while end < len(raws) and size + len(raws[end]) < SLAB:
            size += len(raws[end]) + 1
            end += 1
        group = raws[at:end]
        words, places = word_hashes(b" ".join(group))
        edges = np.searchsorted(places, np.cumsum([0, *(len(r) + 1 for r in group)])).tolist()
        runs = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for j in range(width):
            runs += words[j : j + len(runs)] * _PLACES[j]
        runs = _mix(runs)
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a >= width:
                out.append(np.unique(runs[a : b - width + 1]))
            elif b > a:
                out.append(_mix((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + _U(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of non-empty sets: leading zeros of the smallest hash, then mantissa bits."""
    out = np.empty((len(sets), REGISTERS), dtype=np.uint16)
    at = 0
    while at < len(sets):
        end, size = at + 1, len(sets[at])
        while end < len(sets) and size + len(sets[end]) <= 1 << 15:  # stays in the cache
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[at:end])
        first = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        least = np.empty((end - at, REGISTERS), dtype=np.uint64)
        for j in range(REGISTERS):
            least[:, j] = np.minimum.reduceat(flat * _MULTIPLIERS[j], first)
        _, bits = np.frexp((least >> _U(11)).astype(np.float64))  # bits of the top 53, exactly
        bits = np.maximum(bits, MANTISSA + 1)
        mantissa = (least >> _U(11)) >> (bits - 1 - MANTISSA).astype(np.uint64) & _U((1 << MANTISSA) - 1)
        out[at:end] = ((53 - bits) << MANTISSA) + mantissa.astype(np.int64)
        at = end
    return out


@lru_cache(maxsize=4096)
def _chance_at(low: int, high: int) -> float:
    """Chance that registers of unrelated sets of 2**(low/2) and 2**(high/2) shingles agree."""
    lz = np.arange(53 - MANTISSA)[:, None]
    m = np.arange(1 << MANTISSA)[None, :]
    left = 2.0 ** -(lz + 1) * (1 + m / (1 << MANTISSA))
    right = left + 2.0 ** -(lz + 1) / (1 << MANTISSA)

    def mass(n: float) -> np.ndarray:
        return np.exp(n * np.log1p(-left)) - np.exp(n * np.log1p(-np.minimum(right, 1 - 1e-16)))

    return float((mass(2 ** (low / 2)) * mass(2 ** (high / 2))).sum())


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    la, lb = (np.round(2 * np.log2(np.maximum(n, 1))).astype(int) for n in (n_a, n_b))
    keys, back = np.unique(la * 256 + lb, return_inverse=True)
    chance = np.array([_chance_at(int(k) // 256, int(k) % 256) for k in keys])[back] if len(keys) else np.empty(0)
    return (equal / REGISTERS - chance) / (1 - chance)


def estimate_cut(threshold: float) -> float:
    """Estimates below this are dropped: ``SLACK`` standard errors below the threshold."""
    return threshold - SLACK * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))


def _bands(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, fingerprint (128 bits of the set; null if empty), bands (the registers, four to a long)."""
    session(docs)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            for i, row in zip(full, registers([sets[i] for i in full]).view("<i8"), strict=True):
                bands[i] = row
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "fingerprint", "bands"],
            )
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(sketch, "doc_id long, n_shingles long, fingerprint binary, bands array<long>")


def _few(ids: DataFrame) -> DataFrame:
    """``ids`` to join with, as a broadcast while its values are at most ``BROADCAST_IDS``."""
    return F.broadcast(ids) if len(ids.columns) * ids.count() <= BROADCAST_IDS else ids


def _likely(met: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``met`` (rep, hub) whose sizes allow the similarity and whose estimate is near enough.

    Repeats of a pair meet at its ``rep``, which has few hubs; only the second
    join is by hub. Repeated ids may leave a few repeats of a pair.
    """
    cut = estimate_cut(percent / 100)
    own = met.groupBy("rep").agg(F.collect_set("hub").alias("hubs")).join(reps.select("rep", "n", "bands"), "rep")
    own = own.select(F.col("rep").alias("a"), F.explode("hubs").alias("b"), F.col("n").alias("n_a"), F.col("bands").alias("bands_a"))
    sides = own.join(reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bands").alias("bands_b")), "b")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(k).to_numpy() for k in (2, 3))
            equal = (_bands(batch.column(4)) == _bands(batch.column(5))).sum(axis=1)
            good = estimate(equal, n_a, n_b) >= cut
            found = np.unique(np.stack([batch.column(k).to_numpy()[good] for k in (0, 1)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[k]) for k in (0, 1)], names=["a", "b"])

    close = sides.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "bands_a", "bands_b")
    return close.mapInArrow(keep, "a long, b long")


def _sets(ids: DataFrame, docs: DataFrame, width: int, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids``, which may repeat: their full shingle sets, made anew from the texts."""
    if ids.count() > BROADCAST_IDS:
        ids = scratch.put(ids.distinct(), f"{name}-few")
    some = _few(ids)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return scratch.put(docs.join(some, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets_of, "doc_id long, shingles binary"), f"{name}-sets")


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity; repeats stay."""
    ids = scratch.put(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")  # hubs repeat often
    sets = _sets(ids, docs, width, scratch, name)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for raw_a, raw_b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(raw.as_buffer(), np.uint64) for raw in (raw_a, raw_b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    wide = pairs
    for side in ("b", "a"):
        wide = wide.join(sets.select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    links = scratch.put(wide.select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-ids", f"{name}-few")
    return links


#: Masks whose exclusive or with an id gives the orders that pick a bucket's hubs; the first picks the smallest id.
_HUBS = (0, *(int(x >> _U(2)) for x in _stream(5, 3)))


def near_duplicate_classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have Jaccard similarity of ``percent`` or more.

    1. One pass over the texts makes shingle sets and HyperMinHash sketches;
       documents with the same set (128-bit fingerprint) share a representative.
    2. Representatives meet in buckets of equal band values (32 bands of four
       registers: at 85 % a linked pair misses all of them with a chance of
       5e-11, at 80 % of 5e-8).
    3. Each member of a bucket is compared with up to four hubs, not with every
       other member, so a bucket costs as many pairs as rows. Pairs go through
       the size bound, the collision-corrected estimate and then full sets.
    4. Confirmed links are merged to components. In a bucket of more than one
       block that still holds several, the members that meet most others over
       all such buckets are tried as further hubs, one for each of up to four
       components, as long as that joins any: the text that a group's copies
       were edited from shares more bands with them than they share with each
       other.
    5. Buckets of more than one block that hold several components even then are
       joined exactly by what their members' full sets do not share with the
       group's common text (``_group_links``): each member goes on a few lists,
       whatever the size of the group.
    6. Smaller buckets that hold several components are the remainder: there, in
       blocks of bounded rows and bytes, all members of different components are
       compared by sketch, and the members that are near enough to another meet
       again with their full sets. A block only gives out the links that join
       components, never its pairs. So no link between components is lost to the
       hubs.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id
    reachable, itself included), kept (doc_id = component_id). Documents without
    words, or with null text, have no shingles and no links. Rows that repeat an
    id are one node and share its component. Rows with a null id take no part:
    component_id is null and they are kept. An empty table gives an empty result.
    """
    spark = session(docs)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = scratch.put(sketches(docs, width), "sketches")
    members = sketch.where("fingerprint is not null and doc_id is not null")
    reps = scratch.put(members.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "reps")

    rows = reps.select("rep", "n", F.posexplode("bands").alias("band", "value"))
    orders = [F.min(F.col("rep").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in _HUBS]
    buckets = rows.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size"), F.array_distinct(F.array(*orders)).alias("hubs")).where("size > 1")
    inside = scratch.put(rows.join(buckets, ["band", "value"]), "buckets")
    stars = inside.select("rep", "hubs", F.explode("hubs").alias("hub")).where("rep <> hub and (rep > hub or not array_contains(hubs, rep))")  # two hubs meet once
    pairs = scratch.put(_likely(stars.select("rep", "hub"), reps, percent), "pairs")
    links = _verify(pairs, docs, width, percent, scratch, "hubs")
    component = scratch.put(connected_components(links, scratch, "hub-components"), "merged")

    large, turn = inside.where(F.col("size") > BLOCK), 0
    while not large.isEmpty():
        turn += 1
        large = _split(large, component, scratch, f"large-{turn}")
        if large.isEmpty():
            break
        large = scratch.put(large.withColumn("met", F.sum("size").over(Window.partitionBy("rep"))), f"placed-{turn}")
        central = scratch.put(_likely(_central_pairs(large, scratch, f"centres-{turn}"), reps, percent), f"central-{turn}")
        links = _verify(central, docs, width, percent, scratch, f"central-{turn}")
        if links.isEmpty():  # the next turn would try the same members again
            break
        component = _merged(component, _between(links, component), scratch, f"components-{turn}")
    if not large.isEmpty():
        component = _merged(component, _group_links(large, docs, width, percent, scratch), scratch, "components-groups")
    split = _split(inside.where((F.col("size") > 2) & (F.col("size") <= BLOCK)), component, scratch, "split")
    if not split.isEmpty():
        component = _merged(component, _remainder(split, reps, docs, width, percent, scratch), scratch, "components")
    scratch.drop("buckets", "pairs", "split", *(f"{name}-{k}" for k in range(1, turn + 1) for name in ("large", "placed", "centres", "central")))

    of_rep = reps.select("fingerprint", "rep").join(_few(component.withColumnRenamed("node", "rep")), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("root"))
    least = sketch.select("doc_id", "n_shingles", "fingerprint").join(of_rep, "fingerprint", "left")
    return least.select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its class, with their own columns.

    Rows with a null id stay. Rows that repeat an id stay or go together. The
    dropped ids are broadcast while there are at most ``BROADCAST_IDS``; beyond
    it the anti join shuffles.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup-drop")
    (name,) = fresh(docs, "_gone")
    gone = scratch.put(near_duplicate_classes(docs, width, percent, id_col, text_col).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "gone")
    some = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(some, F.col(id_col).cast("long") == F.col(name), "left_anti")


_KEY = ["band", "value", "i", "j"]


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str] = _KEY) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches sorted by it."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            last = np.array([kept[0].column(c)[0].as_py() for c in key]) if kept else keys[0]
            same = (keys == last).all(axis=1)
            end = len(same) if same.all() else int(np.argmin(same))
            if end:
                kept.append(batch.slice(0, end))
            if end < batch.num_rows:
                yield pa.Table.from_batches(kept)
                kept = []
            batch = batch.slice(end)
    if kept:
        yield pa.Table.from_batches(kept)


def _near(rows: pa.Table, percent: int, cut: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row the others of its key that may be links: (row, rows, estimates).

    They stand in the key's two blocks, in different components, are near
    enough in size and by estimate, and share no earlier band: so a pair is met
    in one key only.
    """
    band, i, j = (rows.column(c)[0].as_py() for c in ("band", "i", "j"))
    block, root, n = (rows.column(c).to_numpy() for c in ("block", "root", "n"))
    regs = _bands(rows.column("bands").combine_chunks())
    bands = regs.view(np.int64)
    for x in np.flatnonzero(block == i).tolist():
        with_ = np.flatnonzero(block == j) if i != j else np.arange(x + 1, len(n))
        low, high = np.minimum(n[x], n[with_]), np.maximum(n[x], n[with_])
        with_ = with_[(root[with_] != root[x]) & (100 * low >= percent * high)]
        with_ = with_[(bands[with_] == bands[x]).argmax(axis=1) == band] if len(with_) else with_
        if len(with_):
            near = estimate((regs[with_] == regs[x]).sum(axis=1), np.full(len(with_), n[x]), n[with_])
            if (good := near >= cut).any():
                yield x, with_[good], near[good]


def _between(links: DataFrame, component: DataFrame) -> DataFrame:
    """The links (a, b) as links of components; those inside one are gone."""
    for side in ("a", "b"):
        of = _few(component.select(F.col("node").alias(side), F.col("component").alias("root")))
        links = links.join(of, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    return links.where("a <> b")


def _merged(component: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The components (node, component) after further links (a, b) of components; only these links are contracted."""
    if links.isEmpty():
        return component
    roots = scratch.put(connected_components(links, scratch, name), f"{name}-roots")
    moved = component.join(_few(roots.select(F.col("node").alias("root"), F.col("component").alias("least"))), F.col("component") == F.col("root"), "left")
    moved = moved.where("root is null or node <> root").select("node", F.coalesce("least", "component").alias("component"))
    return scratch.put(moved.unionByName(roots), f"{name}-merged")


def _split(members: DataFrame, component: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The members of buckets that hold several components: band, value, rep, root, n, size and the bucket's shingles.

    Partial minima, maxima and sums leave one row a bucket and task, so a hot
    bucket is no large group here.
    """
    key = ["band", "value"]
    held = members.join(_few(component.withColumnRenamed("node", "rep")), "rep", "left").select(*key, "rep", F.coalesce("component", "rep").alias("root"), "n")
    held = scratch.put(held, f"{name}-held")
    of = held.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    split = scratch.put(of.where("lo <> hi").drop("lo", "hi"), f"{name}-buckets")
    out = scratch.put(held.join(F.broadcast(split) if split.count() <= BROADCAST_BUCKETS else split, key), name)
    scratch.drop(f"{name}-held", f"{name}-buckets")
    return out


def _central_pairs(split: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(rep, hub): each member of a split bucket with the central members of other components, ``CENTRES`` at most."""
    key = ["band", "value"]
    best = split.groupBy(*key, "root").agg(F.max(F.struct("met", "rep")).alias("best"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("best")))
    hubs = scratch.put(best.withColumn("rank", rank).where(F.col("rank") <= CENTRES).select(*key, F.col("root").alias("hub_root"), F.col("best.rep").alias("hub")), name)
    met = split.join(F.broadcast(hubs) if hubs.count() <= BROADCAST_BUCKETS else hubs, key)
    return met.where("root <> hub_root").select("rep", "hub")


def _group_links(large: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of different components in buckets of more than one block; exact, for every pair of a bucket.

    Buckets with the same best-placed member are one group. Let C be the
    shingles that more than half of a group holds (any C is right, this one is
    short to describe members by), and A' what A and C do not share. Then A and
    B differ where A' and B' differ, and

        J(A, B) >= p %  iff  |A' & B'| >= (v(A) + v(B)) / (2 (100 + p)),  v(A) = (100 + p) |A'| - (100 - p) |A|.

    So members need to meet only where their differences do. Shingles of A' are
    ordered from rare to common, those that no other member's difference has are
    counted and dropped, and a pair that must share o of them shares its first
    within the first |A'| - o + 1 of each: members go on a list for each of
    these. On a list whose members share l shingles, those that must share no
    more are linked to the member of least v without a comparison (every such
    pair is linked, and both to that member). For the others a list of more than
    ``BLOCK`` members goes on to lists of l + 1 shared shingles by the same rule,
    until lists are short or hold one component. Short lists are compared by the
    full differences. A list that would go on to more rows than its blocks have
    pairs is compared in blocks in place of that.
    """
    key, whole = ["band", "value"], 2 * (100 + percent)
    best = scratch.put(large.groupBy(key).agg(F.max(F.struct("met", "rep"))["rep"].alias("grp")), "group-best")
    few = best.count() <= BROADCAST_BUCKETS
    members = scratch.put(large.join(F.broadcast(best) if few else best, key).select("grp", "rep", "root").distinct(), "group-members")
    sets = _sets(members.select(F.col("rep").alias("doc_id")), docs, width, scratch, "group")
    held = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(raw.as_buffer(), np.int64) for raw in batch.column(1)]
            grp = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], names=["grp", "token"])

    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    counts = held.select("grp", "shingles").mapInArrow(explode, "grp long, token long").groupBy("grp", "token").agg(F.count(F.lit(1)).alias("c"))
    common = counts.join(F.broadcast(sizes), "grp").where(COMMON * F.col("c") > F.col("size"))
    common = scratch.put(common.groupBy("grp", "size").agg(F.sort_array(F.collect_list(F.struct("token", "c"))).alias("t")).select("grp", "size", "t.token", "t.c"), "group-common")

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, often, rarely = [], [], []
            for raw, size, token, c in zip(batch.column(3), batch.column(4).to_pylist(), batch.column(5), batch.column(6), strict=True):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                token, c = (np.empty(0, np.int64) if x.values is None else x.values.to_numpy() for x in (token, c))
                has, centre = np.isin(token, own), 2 * c > size
                gap, times = has != centre, np.where(centre, size - c, c)
                rare = own[~np.isin(own, token)]
                v.append((100 + percent) * (int(gap.sum()) + len(rare)) - (100 - percent) * len(own))
                often.append([{"c": int(times[k]), "token": int(token[k])} for k in np.flatnonzero(gap & (times > 1))])
                rarely.append(rare)
            kind = pa.list_(pa.struct([("c", pa.int64()), ("token", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(v, pa.int64()), pa.array(often, kind), pa.array(rarely, pa.list_(pa.int64()))], names=["grp", "rep", "root", "v", "often", "rarely"])

    apart = held.join(F.broadcast(common), "grp", "left").select("grp", "rep", "root", "shingles", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("token", F.array()).alias("token"), F.coalesce("c", F.array()).alias("c"))
    apart = scratch.put(apart.mapInArrow(differ, "grp long, rep long, root long, v long, often array<struct<c long, token long>>, rarely array<long>"), "group-apart")
    met = apart.select("grp", "rep", F.explode("rarely").alias("token")).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("grp", "token"))).where("c > 1")
    met = met.groupBy("grp", "rep").agg(F.collect_list(F.struct("c", "token")).alias("met"))
    ordered = F.array_sort(F.concat("often", F.coalesce("met", F.array())))["token"]
    rows = apart.join(met, ["grp", "rep"], "left").select(F.col("grp").alias("list"), "rep", "root", "v", ordered.alias("tokens"), F.lit(-1).alias("at"))
    rows = scratch.put(rows, "group-lists-0")

    links, depth = [], 0
    while True:
        per = rows.groupBy("list").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("tokens")).alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("v", "rep", "root")).alias("least"))
        per = scratch.put(per.where("lo <> hi").select("list", "size", "held", F.col("least.v").alias("least"), F.col("least.root").alias("hub_root")), f"group-sizes-{depth}")
        lists, longest = per.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
        some = F.broadcast(per) if lists <= BROADCAST_BUCKETS else per
        must = F.greatest(F.lit(depth + 1), F.ceil((F.col("v") + F.col("least")) / whole)).cast("int")
        on = F.greatest(F.lit(0), F.size("tokens") - must + depth - F.col("at"))
        blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("held") / BLOCK_BYTES)).cast("int")
        wide = scratch.put(rows.join(some, "list").withColumns({"on": on, "blocks": blocks}), f"group-wide-{depth}")
        stars = wide.where((F.col("v") + F.col("least") <= whole * depth) & (F.col("root") != F.col("hub_root")))
        links.append(scratch.put(stars.select(F.least("root", "hub_root").alias("a"), F.greatest("root", "hub_root").alias("b")), f"group-stars-{depth}"))
        fan = FAN * F.col("size") if not depth else F.lit(0)
        goes = wide.where(F.col("size") > BLOCK).groupBy("list", "size", "blocks").agg(F.sum("on").alias("on")).where(F.col("on") <= F.greatest(fan, F.col("size") * F.col("blocks")))
        goes = scratch.put(goes.select("list"), f"group-goes-{depth}") if longest > BLOCK else rows.select("list").limit(0)
        some = F.broadcast(goes) if goes.count() <= BROADCAST_BUCKETS else goes
        links.append(scratch.put(_list_links(wide.join(some, "list", "left_anti"), percent), f"group-links-{depth}"))
        ahead = wide.join(some, "list", "left_semi").where("on > 0").withColumn("at", F.explode(F.sequence(F.col("at") + 1, F.col("at") + F.col("on"))))
        rows = scratch.put(ahead.select(F.xxhash64("list", F.get("tokens", "at")).alias("list"), "rep", "root", "v", "tokens", "at"), f"group-lists-{depth + 1}")
        scratch.drop(f"group-lists-{depth}", f"group-sizes-{depth}", f"group-wide-{depth}", f"group-goes-{depth}")
        depth += 1
        if rows.isEmpty():
            break
    found = scratch.put(reduce(DataFrame.unionByName, links).distinct(), "group-found")
    scratch.drop("group-best", "group-members", "group-few", "group-sets", "group-common", "group-apart", f"group-lists-{depth}", *(f"group-{k}-{d}" for k in ("stars", "links") for d in range(depth)))
    return found


def _list_links(wide: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of different components on lists: list, rep, root, v, tokens and the list's number of blocks."""
    parts = partitions(session(wide))
    key = ["list", "i", "j"]
    dealt = wide.withColumns({"block": F.pmod(F.xxhash64("rep"), "blocks").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    dealt = dealt.select("list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "root", "v", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, key):
            i, j = (rows.column(c)[0].as_py() for c in ("i", "j"))
            block, root, v = (rows.column(c).to_numpy() for c in ("block", "root", "v"))
            if (root == root[0]).all() or (i != j and len({*block.tolist()}) < 2):
                continue
            tokens = rows.column("tokens").combine_chunks()
            row = np.repeat(np.arange(len(root)), tokens.value_lengths().to_numpy())
            _, place, times = np.unique(tokens.flatten().to_numpy(), return_inverse=True, return_counts=True)
            row, place = row[times[place] > 1], (np.cumsum(times > 1) - 1)[place[times[place] > 1]]
            order = np.argsort(place, kind="stable")
            row, place = row[order], place[order]
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            both = np.zeros((len(left), len(right)), dtype=np.float32)
            for at in range(0, int((times > 1).sum()), STRIP):
                lo, hi = np.searchsorted(place, [at, at + STRIP])
                strip = np.zeros((len(root), STRIP), dtype=np.float32)
                strip[row[lo:hi], place[lo:hi] - at] = 1
                both += strip[left] @ strip[right].T
            good = (2 * (100 + percent) * both.astype(np.int64) >= v[left][:, None] + v[right][None, :]) & (root[left][:, None] != root[right][None, :])
            up: dict[int, int] = {}

            def find(c: int) -> int:
                while (p := up.get(c, c)) != c:
                    c = p
                return c

            found: list[tuple[int, int]] = []
            for x, y in zip(*(k.tolist() for k in np.nonzero(np.triu(good, 1) if i == j else good)), strict=True):
                a, b = find(int(root[left[x]])), find(int(root[right[y]]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    found.append((min(a, b), max(a, b)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        trim()

    return dealt.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(compare, "a long, b long")


def _remainder(split: DataFrame, reps: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) of different components in the split buckets.

    A bucket, of ``BLOCK`` members at most, is dealt into blocks by its bytes,
    and every pair of its blocks meets in one task.
    """
    spark, cut = session(split), estimate_cut(percent / 100)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(8 * F.col("shingles") / BLOCK_BYTES)).cast("int")
    placed = split.join(reps.select("rep", "bands"), "rep").select("*", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("band", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "root", "n", "bands")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            hit = np.zeros(rows.num_rows, dtype=bool)
            for x, with_, _ in _near(rows, percent, cut):
                hit[x] = True
                hit[with_] = True
            if hit.any():
                yield from rows.filter(pa.array(hit)).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches):
            root = rows.column("root").to_numpy()
            sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in rows.column("shingles")]
            up: dict[int, int] = {}

            def find(c: int) -> int:
                while (p := up.get(c, c)) != c:
                    c = p
                return c

            found: list[tuple[int, int]] = []
            for x, with_, near in _near(rows, percent, cut):
                for y in with_[np.argsort(-near, kind="stable")].tolist():
                    a, b = find(int(root[x])), find(int(root[y]))
                    if a == b:
                        continue
                    place = np.searchsorted(sets[x], sets[y])
                    place[place == len(sets[x])] = 0
                    both = int((sets[x][place] == sets[y]).sum())
                    if 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        up[max(a, b)] = min(a, b)
                        found.append((min(a, b), max(a, b)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    parts = partitions(spark)
    schema = "band int, value long, i int, j int, block int, rep long, root long, n long, bands array<long>"
    dealt = placed.select(*[c.split()[0] for c in schema.split(", ")]).repartition(parts, *_KEY).sortWithinPartitions(*_KEY)
    hits = scratch.put(dealt.mapInArrow(compare, schema), "hits")
    sets = _sets(hits.select(F.col("rep").alias("doc_id")), docs, width, scratch, "hits")
    full = hits.join(sets.withColumnRenamed("doc_id", "rep"), "rep").repartition(parts, *_KEY).sortWithinPartitions(*_KEY)
    links = scratch.put(full.select(*hits.columns, "shingles").mapInArrow(confirm, "a long, b long"), "rest-links")
    scratch.drop("hits", "hits-sets", "hits-few")
    return links
