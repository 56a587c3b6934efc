"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Links that the driver contracts by itself at most (16 bytes each); more are contracted in rounds of the cluster.
DRIVER_LINKS = 500_000


def connected_components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it reaches.

    ``links`` is counted first and so should be a written table. A round of the
    cluster costs some seven shuffles, whatever its size, so a link table that
    is small by count goes to the driver. For larger ones,
    large-star and small-star steps alternate until the edges are stars around
    the smallest nodes; edges never outnumber the input's, and the number of
    rounds grows with the logarithm of the longest path. Every round is a
    written table, so a lost executor repeats one round at most. Loops and
    repeated links are harmless; links with null are ignored.
    """
    links = links.where("a is not null and b is not null and a <> b")
    if links.count() <= DRIVER_LINKS:
        found = links.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
        node, component = contracted(*(found.column(k).to_numpy() for k in ("a", "b")))
        return links.sparkSession.createDataFrame(pa.table({"node": node, "component": component}))
    big, low = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges = scratch.put(links.select(big, low).distinct(), f"{name}-0")
    sign = _signature(edges)
    rounds = 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rounds += 1
        edges = scratch.put(small.unionByName(lows.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{rounds}")
        scratch.drop(f"{name}-{rounds - 1}")
        before, sign = sign, _signature(edges)
        if sign == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the smallest node that each reaches.

    Roots hang below the smallest root they are linked to, then paths are
    shortened: every two rounds, at least half of a component's roots go.
    """
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(ids))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = low[apart], high[apart]
        np.minimum.at(root, y, x)
        while (root != (up := root[root])).any():
            root = up
    return ids, ids[root]


def _signature(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
