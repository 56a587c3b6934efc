"""Cleaning, quality gate, splits and rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import coerce_number, consolidate, mix32, normalize_label, sentinel_to_null


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def clean(df: DataFrame, label: str, features: Sequence[str], drop: Sequence[str] = (), mapping: Mapping[str, str] | None = None, benign: str = "BENIGN", sentinels: Sequence[str] = ()) -> DataFrame:
    """Trim headers, normalise labels, drop identifiers, coerce numbers, null sentinels, build targets, drop exact duplicates."""
    df = trim_headers(df)
    df = df.withColumn(label, consolidate(normalize_label(F.col(label)), mapping or {})).drop(*drop)
    have = [c for c in features if c in df.columns]
    df = df.withColumns({c: coerce_number(F.col(f"`{c}`")) for c in have})
    df = df.withColumns({c: sentinel_to_null(F.col(f"`{c}`")) for c in sentinels if c in df.columns})
    df = df.withColumns({"label_binary": (F.col(label) != benign).cast("long"), "label_multiclass": F.col(label)})
    return df.dropDuplicates()


def quality_gate(df: DataFrame, required: Sequence[str], label: str, vocabulary: Sequence[str], max_null: float = 0.5, max_duplicate: float = 0.2) -> DataFrame:
    """One row per check: name, measured, limit, ok.

    Rows, missing columns, unknown labels, largest null share of a column,
    duplicate share, number of classes. An empty table fails the first check and
    has no others.
    """
    missing = [c for c in required if c not in df.columns]
    present = [c for c in required if c in df.columns]
    nulls = [F.avg(F.col(f"`{c}`").isNull().cast("double")) for c in present]
    sums = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col(label).isin(list(vocabulary))).alias("unknown"), F.count_distinct(label).alias("classes"),
        (F.greatest(*nulls) if len(nulls) > 1 else nulls[0] if nulls else F.lit(0.0)).alias("null_share"),
    )
    groups = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("extra"))
    row = sums.crossJoin(groups)
    check = lambda name, value, limit, ok: F.struct(F.lit(name).alias("name"), value.cast("double").alias("measured"), F.lit(float(limit)).alias("required"), ok.alias("ok"))
    n, extra = F.col("n"), F.col("extra") / F.greatest(F.col("n"), F.lit(1))
    checks = [
        check("rows", n, 1, n > 0), check("missing_columns", F.lit(len(missing)), 0, F.lit(not missing)), check("unknown_labels", F.col("unknown"), 0, F.col("unknown") == 0),
        check("null_share", F.col("null_share"), max_null, F.col("null_share") <= max_null), check("duplicate_share", extra, max_duplicate, extra <= max_duplicate), check("classes", F.col("classes"), 2, F.col("classes") >= 2),
    ]
    return row.select(F.inline(F.when(n > 0, F.array(*checks)).otherwise(F.array(checks[0]))))


def content_digest(df: DataFrame) -> DataFrame:
    """Order-insensitive digest of a table: row count, sum and exclusive or of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def hash_draw(key: Column, seed: int, modulus: int = 1 << 32) -> Column:
    """A uniform draw in [0, 1) from a whole key, by arithmetic that any SQL engine repeats."""
    return F.pmod(F.pmod(mix32(key) + seed * 40503, F.lit(1 << 32)) * 69069 + F.pmod(key, F.lit(1 << 31)), F.lit(modulus)) / float(modulus)


def temporal_split(df: DataFrame, day: str, test_days: Sequence, key: str, validation: float = 0.2, stratum: str | None = None, seed: int = 7) -> DataFrame:
    """Adds part: 'test' for the given days; of the rest a stratified share is 'val', the others 'train'."""
    is_test = F.col(day).isin(list(test_days))
    strata = [stratum] if stratum else []
    held = df.withColumn("_test", is_test)
    w = Window.partitionBy("_test", *strata)
    rank = F.row_number().over(w.orderBy(hash_draw(F.col(key), seed), key))
    val = rank <= F.floor(F.count(F.lit(1)).over(w) * validation)
    return held.withColumn("part", F.when(F.col("_test"), "test").when(val, "val").otherwise("train")).drop("_test")


def stratified_split(df: DataFrame, stratum: str, key: str, test: float = 0.2, validation: float = 0.2, seed: int = 7) -> DataFrame:
    """Adds part by the rank of a hash within each stratum: exact shares, the same on every run."""
    w = Window.partitionBy(stratum)
    rank, n = F.row_number().over(w.orderBy(hash_draw(F.col(key), seed), key)), F.count(F.lit(1)).over(w)
    t = F.floor(n * test)
    v = F.floor((n - t) * validation)
    return df.withColumn("part", F.when(rank <= t, "test").when(rank <= t + v, "val").otherwise("train"))


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of keys that two parts share; 0 for a sound split."""
    return a.join(b, key, "left_semi").agg(F.count(F.lit(1)).alias("shared"))


def leave_one_out(df: DataFrame, label: str, held: str, benign: str, part: str = "part") -> DataFrame:
    """Train on everything but ``held``; test on the benign test rows and every row of ``held``."""
    rest = df.where(F.col(label) != held)
    unseen = df.where(F.col(label) == held).withColumn(part, F.lit("test"))
    return rest.where((F.col(part) != "test") | (F.col(label) == benign)).unionByName(unseen)


#: One clause of a rule: column, comparison (ge, le, eq), value.
Clause = tuple[str, str, float]


def rule_column(df: DataFrame, clauses: Sequence[Clause]) -> Column:
    """All clauses hold; null never satisfies, an absent column never fires."""
    if not clauses or any(c not in df.columns for c, _, _ in clauses):
        return F.lit(False)
    test = {"ge": lambda c, v: c >= v, "le": lambda c, v: c <= v, "eq": lambda c, v: c == v}
    return F.coalesce(reduce(lambda a, b: a & b, [test[op](F.col(c), v) for c, op, v in clauses]), F.lit(False))


def rule_matrix(df: DataFrame, rules: Mapping[str, Sequence[Clause]]) -> DataFrame:
    """One boolean per rule, rule_any, and rule_score (the share of rules that fire)."""
    cols = {f"rule_{name}": rule_column(df, clauses) for name, clauses in rules.items()}
    out = df.withColumns(cols)
    hits = [F.col(c) for c in cols]
    return out.withColumns({"rule_any": reduce(lambda a, b: a | b, hits), "rule_score": sum((h.cast("double") for h in hits), F.lit(0.0)) / len(hits)})


def rule_statistics(matrix: DataFrame, names: Sequence[str], label: str, y: str = "y") -> DataFrame:
    """Per rule: fired, precision, attack recall, most frequent class among its true positives (ties: first by name)."""
    kinds = ", ".join(f"'{n}', rule_{n}" for n in names)
    long = matrix.select(label, y, F.expr(f"stack({len(names)}, {kinds}) as (rule, fired)"))
    base = long.groupBy("rule").agg(F.count_if("fired").alias("fired"), F.count_if(F.col("fired") & (F.col(y) == 1)).alias("tp"), F.sum(y).alias("attacks"))
    by = long.where(F.col("fired") & (F.col(y) == 1)).groupBy("rule", label).agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("rule").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("t")).select("rule", F.col("t.l").alias("dominant"))
    rate = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return base.join(top, "rule", "left").select("rule", "fired", rate("tp", "fired").alias("precision"), rate("tp", "attacks").alias("recall"), F.coalesce("dominant", F.lit("-")).alias("dominant"))


def subsample(df: DataFrame, label: str, key: str, fraction: float, seed: int = 7) -> DataFrame:
    """An exact share of each class, at least one row, by hash rank."""
    w = Window.partitionBy(label)
    rank = F.row_number().over(w.orderBy(hash_draw(F.col(key), seed), key))
    return df.withColumn("_r", rank).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).drop("_r", "_n")


def flip_labels(df: DataFrame, y: str, key: str, rate: float, seed: int = 7) -> DataFrame:
    """Exactly floor(n * rate) attack rows, by hash rank, become benign; adds flipped."""
    w = Window.partitionBy(y)
    rank = F.row_number().over(w.orderBy(hash_draw(F.col(key), seed), key))
    out = df.withColumn("flipped", (F.col(y) == 1) & (rank <= F.floor(F.count(F.lit(1)).over(w) * rate)))
    return out.withColumn(y, F.when(F.col("flipped"), 0).otherwise(F.col(y)))


def assign_shards(df: DataFrame, key: str, shards: int, seed: int = 7) -> DataFrame:
    """Adds shard: a seeded hash of the key; deleting a row touches one shard."""
    return df.withColumn("shard", F.floor(hash_draw(F.col(key), seed) * shards).cast("int"))
