"""Packets to bidirectional flows and their feature columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = (1 << k for k in range(8))
#: Flag columns of the public flow schema and their bits (fixed values).
FLAG_COLUMNS = {"FIN Flag Count": FIN, "SYN Flag Count": SYN, "RST Flag Count": RST, "PSH Flag Count": PSH, "ACK Flag Count": ACK, "URG Flag Count": URG, "ECE Flag Count": ECE, "CWE Flag Count": CWR}
#: Columns of the public flow schema that bulk transfers would fill (fixed values).
BULK_COLUMNS = ("Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate", "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate")


def flow_key() -> Column:
    """Both directions of a conversation share it."""
    ends = F.array_sort(F.array(F.concat_ws(":", "src_ip", "src_port"), F.concat_ws(":", "dst_ip", "dst_port")))
    return F.concat_ws("|", "protocol", ends)


class FlowState:
    """Where one conversation's current flow stands; also the state of the streaming assembler."""

    def __init__(self, timeout_us: int) -> None:
        self.timeout, self.number, self.source, self.last, self.fins, self.closed = timeout_us, -1, None, 0, 0, False

    def add(self, stamp: int, source: str, flags: int) -> tuple[int, bool]:
        """The packet's flow number and whether it runs forward.

        A flow ends after a reset, after FINs both ways, or when a packet comes
        more than the timeout after the last one.
        """
        if self.number < 0 or self.closed or stamp - self.last > self.timeout:
            self.number, self.source, self.fins, self.closed = self.number + 1, source, 0, False
            self.last = stamp
        self.last = max(self.last, stamp)
        forward = source == self.source
        if flags & FIN:
            self.fins |= 1 if forward else 2
        self.closed = self.closed or bool(flags & RST) or self.fins == 3
        return self.number, forward


def assign_flows(packets: DataFrame, timeout_us: int = 120_000_000) -> DataFrame:
    """Adds key, flow (number within the key) and forward.

    One shuffle by conversation; within a partition rows stream in (key, time)
    order through a constant-size state, so a busy conversation needs no memory.
    """
    keyed = packets.withColumn("key", flow_key()).withColumn("_src", F.concat_ws(":", "src_ip", "src_port"))
    names = keyed.columns
    at = {c: names.index(c) for c in ("key", "timestamp_us", "_src", "tcp_flags")}

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, FlowState(timeout_us)
        for batch in batches:
            flows, forwards = [], []
            for k, stamp, source, flags in zip(*(batch.column(at[c]).to_pylist() for c in at), strict=True):
                if k != key:
                    key, state = k, FlowState(timeout_us)
                number, forward = state.add(stamp, source, flags or 0)
                flows.append(number)
                forwards.append(forward)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(flows, dtype=np.int64)), pa.array(forwards, pa.bool_())], names=[*names, "flow", "forward"])

    order = ["key", "timestamp_us", *(c for c in ("path", "seq") if c in names)]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in keyed.dtypes) + ", flow long, forward boolean"
    return keyed.repartition("key").sortWithinPartitions(*order).mapInArrow(assemble, schema).drop("_src")


def _stats(c: Column, name: str) -> list[Column]:
    zero = F.lit(0.0)
    return [F.coalesce(f(c).cast("double"), zero).alias(f"{name} {label}") for f, label in ((F.max, "Max"), (F.min, "Min"), (F.avg, "Mean"), (F.stddev_pop, "Std"))]


def flow_features(assigned: DataFrame, activity_us: int = 5_000_000) -> DataFrame:
    """One row per flow: identity and the 77 feature columns.

    Gaps are lags within the flow and direction; spans of activity are cut at
    pauses over ``activity_us``. Rates of flows without duration are null;
    statistics without values are 0; unset windows are -1.
    """
    order = ["timestamp_us", *(c for c in ("path", "seq") if c in assigned.columns)]
    flow, way = Window.partitionBy("key", "flow").orderBy(*order), Window.partitionBy("key", "flow", "forward").orderBy(*order)
    t = F.col("timestamp_us")
    pause = t - F.lag("timestamp_us").over(flow)
    p = assigned.withColumns({"_n": F.row_number().over(flow), "_gap": pause, "_way_gap": t - F.lag("timestamp_us").over(way), "_way_n": F.row_number().over(way)})
    p = p.withColumn("_span", F.sum(F.when(F.col("_gap") > activity_us, 1).otherwise(0)).over(flow.rowsBetween(Window.unboundedPreceding, 0)))
    spans = p.groupBy("key", "flow", "_span").agg((F.max(t) - F.min(t)).alias("d")).where("d > 0").groupBy("key", "flow").agg(*_stats(F.col("d"), "Active"))
    f, first = F.col("forward"), F.col("_n") == 1
    size, head, flags = F.col("payload_bytes"), F.col("header_bytes"), F.col("tcp_flags")
    fwd, bwd = (lambda c: F.when(f, c)), (lambda c: F.when(~f, c))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    of_first = lambda c: F.max(F.when(first, F.col(c))).alias(f"_{c}")
    window = lambda side: F.coalesce(F.max(F.when((F.col("protocol") == "TCP") & (F.col("_way_n") == 1) & side, F.col("window"))), F.lit(-1)).cast("double")
    per = p.groupBy("key", "flow").agg(
        *[of_first(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")], F.min(t).alias("start_us"), F.count(F.lit(1)).alias("packets"), (F.max(t) - F.min(t)).cast("double").alias("Flow Duration"),
        F.count_if(f).cast("double").alias("Total Fwd Packets"), F.count_if(~f).cast("double").alias("Total Backward Packets"), total(fwd(size)).alias("Total Length of Fwd Packets"), total(bwd(size)).alias("Total Length of Bwd Packets"),
        *_stats(fwd(size), "Fwd Packet Length"), *_stats(bwd(size), "Bwd Packet Length"), *_stats(F.col("_gap"), "Flow IAT"), *_stats(fwd(F.col("_way_gap")), "Fwd IAT"), *_stats(bwd(F.col("_way_gap")), "Bwd IAT"),
        total(fwd(F.col("_way_gap"))).alias("Fwd IAT Total"), total(bwd(F.col("_way_gap"))).alias("Bwd IAT Total"), *_stats(size, "Packet Length"), *_stats(F.when(F.col("_gap") > activity_us, F.col("_gap")), "Idle"),
        *[F.count_if(side & (flags.bitwiseAND(bit) > 0)).cast("double").alias(f"{name} {label} Flags") for name, side in (("Fwd", f), ("Bwd", ~f)) for label, bit in (("PSH", PSH), ("URG", URG))],
        total(fwd(head)).alias("Fwd Header Length"), total(bwd(head)).alias("Bwd Header Length"), *[F.count_if(flags.bitwiseAND(bit) > 0).cast("double").alias(c) for c, bit in FLAG_COLUMNS.items()],
        window(f).alias("Init_Win_bytes_forward"), window(~f).alias("Init_Win_bytes_backward"), F.count_if(f & (size > 0)).cast("double").alias("act_data_pkt_fwd"), F.coalesce(F.min(fwd(head)), F.lit(0)).cast("double").alias("min_seg_size_forward"),
    )
    seconds = F.col("Flow Duration") / 1e6
    rate = lambda c: F.when(seconds > 0, c / seconds)
    fp, bp, fb, bb = (F.col(c) for c in ("Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets"))
    out = per.join(spans, ["key", "flow"], "left").na.fill(0.0, ["Active Max", "Active Min", "Active Mean", "Active Std"])
    out = out.withColumnsRenamed({"Packet Length Max": "Max Packet Length", "Packet Length Min": "Min Packet Length", **{f"_{c}": c for c in ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")}})
    return out.withColumns(
        {
            "Destination Port": F.col("dst_port").cast("double"), "Flow Bytes/s": rate(fb + bb), "Flow Packets/s": rate(fp + bp), "Fwd Packets/s": rate(fp), "Bwd Packets/s": rate(bp), "Packet Length Variance": F.pow("Packet Length Std", 2),
            "Down/Up Ratio": F.when(fp > 0, bp / fp).otherwise(0.0), "Average Packet Size": F.col("Packet Length Mean"), "Avg Fwd Segment Size": F.col("Fwd Packet Length Mean"), "Avg Bwd Segment Size": F.col("Bwd Packet Length Mean"),
            **{c: F.lit(0.0) for c in BULK_COLUMNS}, "Subflow Fwd Packets": fp, "Subflow Fwd Bytes": fb, "Subflow Bwd Packets": bp, "Subflow Bwd Bytes": bb,
        }
    ).drop("key", "flow")
