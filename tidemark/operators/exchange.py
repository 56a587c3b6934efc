"""Private set intersection, dictionary attacks on hashed indicators, label-shift estimation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 2048-bit MODP group of RFC 3526 (fixed value): 2^2048 - 2^1984 - 1 + 2^64 * (floor(2^1918 pi) + 124476).
GROUP_PRIME = int(
    "FFFFFFFFFFFFFFFFC90FDAA22168C234C4C6628B80DC1CD129024E088A67CC74020BBEA63B139B22514A08798E3404DDEF9519B3CD3A431B302B0A6DF25F14374FE1356D6D51C245E485B576625E7EC6F44C42E9A637ED6B0BFF5CB6F406B7EDEE386BFB5A899FA5AE9F24117C4B1FE649286651ECE45B3DC2007CB8A163BF0598DA48361C55D39A69163FA8FD24CF5F83655D23DCA3AD961C62F356208552BB9ED529077096966D670C354E4ABC9804F1746C08CA18217C32905E462E36CE3BE39E772C180E86039B2783A2EC07A28FB5C55DF06F4C52C9DE2BCBF6955817183995497CEA956AE515D2261898FA051015728E5A8AACAA68FFFFFFFFFFFFFFFF",
    16,
)


def to_group(item: str) -> int:
    """An indicator as a square of the group."""
    return pow(int.from_bytes(hashlib.sha256(item.encode()).digest(), "big"), 2, GROUP_PRIME)


def blind(df: DataFrame, value: str, exponent: int, out: str, hashed: bool = False) -> DataFrame:
    """Raise each element (hex; or, unhashed, an indicator) to a secret exponent; adds ``out`` as hex."""
    names = df.columns
    at = names.index(value)

    def raise_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [None if v is None else format(pow(int(v, 16) if hashed else to_group(v), exponent, GROUP_PRIME), "x") for v in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*names, out])

    return df.mapInArrow(raise_, ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + f", {out} string")


def private_intersection(a: DataFrame, b: DataFrame, item: str, secret_a: int, secret_b: int) -> DataFrame:
    """The items of ``a`` that ``b`` holds too, learned from double-blinded values only.

    Each side blinds its own elements and then the other's; equal items meet in
    one equi join of double-blinded values. Items repeat once.
    """
    mine = blind(blind(a.select(item).where(F.col(item).isNotNull()).distinct(), item, secret_a, "_1"), "_1", secret_b, "_2", hashed=True)
    theirs = blind(blind(b.select(F.col(item).alias("_item")).where(F.col("_item").isNotNull()).distinct(), "_item", secret_b, "_1"), "_1", secret_a, "_2", hashed=True).select("_2")
    return mine.join(theirs, "_2", "left_semi").select(item)


def recover_ports(spark: SparkSession, hashed: DataFrame, digest: str, salt: str = "") -> DataFrame:
    """Ports whose salted SHA-256 is in the list: the whole space is enumerated."""
    space = spark.range(65536).select(F.col("id").alias("port"), F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256).alias(digest))
    return hashed.select(digest).distinct().join(space, digest)


def recover_addresses(spark: SparkSession, hashed: DataFrame, digest: str, start: int, count: int) -> DataFrame:
    """IPv4 addresses of a range whose SHA-256 is in the list."""
    v = F.col("id")
    dotted = F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])
    space = spark.range(start, start + count).select(dotted.alias("address"), F.sha2(dotted, 256).alias(digest))
    return hashed.select(digest).distinct().join(space, digest)


def em_prior(posteriors: DataFrame, columns: Sequence[str], source: Sequence[float], rounds: int = 50, tolerance: float = 1e-6) -> list[float]:
    """Target class prior by EM on soft posteriors: one small aggregation per round."""
    q = list(source)
    for _ in range(rounds):
        w = [a / b if b > 0 else 0.0 for a, b in zip(q, source, strict=True)]
        parts = [F.col(c) * x for c, x in zip(columns, w, strict=True)]
        total = sum(parts[1:], parts[0])
        row = posteriors.agg(*[F.avg(F.when(total > 0, p / total).otherwise(0.0)) for p in parts]).first()
        new = [v / sum(row) for v in row] if sum(row) > 0 else q
        moved, q = max(abs(a - b) for a, b in zip(new, q, strict=True)), new
        if moved < tolerance:
            break
    return q


def correct_posteriors(df: DataFrame, columns: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Reweight and renormalise posteriors; one half each where nothing is left."""
    parts = [F.col(c) * float(w) for c, w in zip(columns, weights, strict=True)]
    total = sum(parts[1:], parts[0])
    return df.withColumns({c: F.when(total > 0, p / total).otherwise(0.5) for c, p in zip(columns, parts, strict=True)})
