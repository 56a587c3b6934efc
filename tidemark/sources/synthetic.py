"""Seeded synthetic flows with planted structure, for demonstrations and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import mix32
from tidemark.operators.cumulative import position

#: Shares of classes per synthetic day (label, weight).
CLASSES = (("BENIGN", 0.8), ("DoS", 0.08), ("PortScan", 0.06), ("Bot", 0.03), ("Web Attack", 0.03))
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")


def flows(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """Labelled flows: durations, volumes and flags whose distribution depends on the class; Day follows the row."""
    u = F.rand(seed)
    label, low = F.lit(CLASSES[-1][0]), 1.0
    for name, w in reversed(CLASSES[:-1]):
        low -= dict(CLASSES)[CLASSES[[c for c, _ in CLASSES].index(name) + 1][0]]
        label = F.when(F.col("_u") < low, name).otherwise(label)
    log = lambda mean, sd, s: F.exp(mean + sd * F.randn(seed + s))
    kind = F.col("Label")
    base = spark.range(rows).withColumn("_u", u).withColumn("Label", label)
    return base.select(
        F.col("id").alias("flow_id"), "Label", F.element_at(F.array(*[F.lit(d) for d in DAYS]), (F.col("id") * 5 / max(rows, 1)).cast("int") + 1).alias("Day"),
        (log(10, 2, 1) * F.when(kind == "PortScan", 0.01).otherwise(1.0)).alias("Flow Duration"),
        F.ceil(log(1.5, 1, 2) * F.when(kind == "DoS", 8.0).when(kind == "PortScan", 0.3).otherwise(1.0)).cast("double").alias("Total Fwd Packets"),
        (log(6, 1.5, 3) * F.when(kind == "DoS", 5.0).otherwise(1.0)).alias("Total Length of Fwd Packets"), F.when(kind == "PortScan", F.floor(F.rand(seed + 4) * 65536)).otherwise(F.element_at(F.array(F.lit(80), F.lit(443), F.lit(22), F.lit(53)), (F.floor(F.rand(seed + 5) * 4) + 1).cast("int"))).cast("int").alias("Destination Port"),
        (kind != "BENIGN").cast("long").alias("label_binary"),
    )


def beacon_events(spark: SparkSession, hosts: int = 40, events: int = 50, period_s: int = 60, seed: int = 7) -> DataFrame:
    """Random traffic of many pairs and one pair that calls home every ``period_s`` seconds: src, dst, t."""
    noise = spark.range(hosts * events).select(F.concat(F.lit("10.0.0."), (F.col("id") % hosts).cast("string")).alias("src"), F.concat(F.lit("198.51.100."), F.floor(F.rand(seed) * 5).cast("string")).alias("dst"), F.floor(F.rand(seed + 1) * 86_400).cast("long").alias("t"))
    planted = spark.range(events).select(F.lit("10.0.0.250").alias("src"), F.lit("203.0.113.9").alias("dst"), (F.col("id") * period_s).alias("t"))
    return noise.unionByName(planted)


def foreign_flows(spark: SparkSession, rows: int, seed: int = 7) -> DataFrame:
    """Flows in the short NetFlow schema (milliseconds, totals by direction)."""
    log = lambda mean, s: F.floor(F.exp(mean + F.randn(seed + s))).cast("long")
    return spark.range(rows).select(
        F.lit(6).alias("PROTOCOL"), F.element_at(F.array(F.lit(80), F.lit(443), F.lit(22)), (F.floor(F.rand(seed) * 3) + 1).cast("int")).alias("L4_DST_PORT"), log(6.0, 1).alias("FLOW_DURATION_MILLISECONDS"),
        log(6.5, 2).alias("IN_BYTES"), log(7.5, 3).alias("OUT_BYTES"), (log(1.5, 4) + 1).alias("IN_PKTS"), (log(1.6, 5) + 1).alias("OUT_PKTS"), (F.rand(seed + 6) < 0.2).cast("int").alias("Label"),
    )


def adapt_foreign(df: DataFrame) -> DataFrame:
    """The short schema in the flow columns: microseconds, null-safe rates."""
    ms = F.col("FLOW_DURATION_MILLISECONDS").cast("double")
    rate = lambda c: F.when(ms > 0, c / (ms / 1000))
    fb, bb, fp, bp = (F.col(c).cast("double") for c in ("IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS"))
    return df.select(
        F.col("L4_DST_PORT").cast("double").alias("Destination Port"), (ms * 1000).alias("Flow Duration"), fp.alias("Total Fwd Packets"), bp.alias("Total Backward Packets"), fb.alias("Total Length of Fwd Packets"), bb.alias("Total Length of Bwd Packets"),
        rate(fb + bb).alias("Flow Bytes/s"), rate(fp + bp).alias("Flow Packets/s"), F.when(fp > 0, fb / fp).otherwise(0.0).alias("Fwd Packet Length Mean"), F.when(bp > 0, bb / bp).otherwise(0.0).alias("Bwd Packet Length Mean"), F.when(fp > 0, bp / fp).otherwise(0.0).alias("Down/Up Ratio"), F.col("Label").cast("long").alias("label_binary"),
    )


def correlated_window(spark: SparkSession, rows: int, columns: int, rho: float, seed: int = 7) -> DataFrame:
    """Standard normal columns x0, x1, ... of which any two have correlation ``rho``: the margins are the same at every ``rho``."""
    shared = F.randn(seed)
    own = [(F.sqrt(F.lit(rho)) * F.col("_z") + F.sqrt(F.lit(max(0.0, 1 - rho))) * F.randn(seed + 1 + i)).alias(f"x{i}") for i in range(columns)]
    return spark.range(rows).withColumn("_z", shared).select("id", *own)


def host_stream(scores: DataFrame, y: str, score: str, key: str, rows: int, mix: float, start: int, seed: int = 7) -> DataFrame:
    """A host's flows (pos, score, y): benign scores, and from ``start`` on attack scores with chance ``mix``, drawn by hash from a scored table."""
    placed = position(scores.select(key, y, score), [key], by=[y], name="_i").drop(key)
    sizes = placed.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    draw = lambda salt: mix32(F.col("id") * 2 + salt) / float(1 << 32)
    asked = scores.sparkSession.range(rows).select("id", F.when((F.col("id") >= start) & (draw(seed) < mix), 1).otherwise(0).alias(y))
    asked = asked.join(F.broadcast(sizes), y).withColumn("_i", F.floor(draw(seed + 11) * F.col("_n")) + 1)
    return asked.join(placed, [y, "_i"]).select(F.col("id").alias("pos"), score, y)


def graph_events(spark: SparkSession, hosts: int = 30, fanout: int = 60, chain: int = 4, seed: int = 7) -> DataFrame:
    """Traffic among internal hosts (src, dst, port, t) with one planted scanner and one planted chain of pivots from outside."""
    ip = lambda n: F.concat(F.lit("10.0.0."), n.cast("string"))
    draw = lambda salt: mix32(F.col("id") * 3 + seed * 7919 + salt) / float(1 << 32)
    noise = spark.range(hosts * 10).select(ip(F.col("id") % hosts + 1).alias("src"), ip((F.col("id") % hosts + F.floor(draw(1) * 2) + 1) % hosts + 1).alias("dst"), F.lit(443).alias("port"), F.floor(draw(2) * 86400).alias("t"))
    scan = spark.range(fanout).select(F.lit("10.0.1.250").alias("src"), F.concat(F.lit("10.0.2."), F.col("id").cast("string")).alias("dst"), F.lit(22).alias("port"), F.col("id").alias("t"))
    hop = lambda n: F.concat(F.lit("10.0.3."), n.cast("string"))
    pivots = spark.range(chain).select(F.when(F.col("id") == 0, "203.0.113.77").otherwise(hop(F.col("id"))).alias("src"), hop(F.col("id") + 1).alias("dst"), F.lit(3389).alias("port"), (F.col("id") * 60).alias("t"))
    return noise.unionByName(scan).unionByName(pivots)
