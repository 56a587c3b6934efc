"""Connection logs, findings, flow CSVs and the sinks of scored flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import normalize_label, severity
from tidemark.operators.cumulative import position

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday")
#: Fields of a connection log that are read (fixed values).
CONN_FIELDS = ("ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "history", "orig_pkts", "resp_pkts")


def day_of(name: Column) -> Column:
    """The first weekday, in calendar order, that a file name mentions; null if none."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.contains(d), F.lit(d.capitalize())) for d in DAYS])


def read_flow_csvs(spark: SparkSession, path: str, label: str = "Label") -> DataFrame:
    """Raw flow CSVs (Latin-1, padded headers) as strings, with Day from the file name and a normalised label."""
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    df = raw.withColumn("Day", day_of(F.element_at(F.split(F.input_file_name(), "/"), -1)))
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumn(label, normalize_label(F.col(label))) if label in df.columns else df


def read_conn_log(spark: SparkSession, path: str) -> DataFrame:
    """A connection log as one map<string, string> per record: tab-separated with header directives, or JSON lines.

    Header directives are read once per file; unset fields and nulls are left
    out of the map. Each file keeps its own field order.
    """
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file")).where(F.trim("line") != "")
    head = lines.where(F.col("line").startswith("#")).groupBy("file").agg(
        F.max(F.when(F.col("line").startswith("#fields"), F.col("line"))).alias("fields"), F.max(F.when(F.col("line").startswith("#unset_field"), F.col("line"))).alias("unset")
    )
    names = F.slice(F.split("fields", "\t"), 2, 10_000)
    unset = F.coalesce(F.split("unset", "\t")[1], F.lit("-"))
    rows = lines.where(~F.col("line").startswith("#") & ~F.ltrim("line").startswith("{")).join(F.broadcast(head), "file")
    values = F.split("line", "\t")
    width = F.least(F.size(names), F.size(values))
    table = rows.select("file", F.map_filter(F.map_from_arrays(F.slice(names, F.lit(1), width), F.slice(values, F.lit(1), width)), lambda _, v: v != unset).alias("record"))
    json = lines.where(F.ltrim("line").startswith("{")).select("file", F.map_filter(F.from_json("line", "map<string,string>"), lambda _, v: v.isNotNull()).alias("record"))
    return table.unionByName(json)


def conn_features(log: DataFrame, record: str = "record") -> DataFrame:
    """The flow columns a connection log can speak for, with the identity beside them.

    Zero or missing durations give null rates; means over zero packets are 0;
    flag counts are the history's letters.
    """
    num = lambda key: F.col(record)[key].try_cast("double")
    sec, fp, bp, fb, bb = (num(k) for k in ("duration", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes"))
    rate = lambda x: F.when(sec > 0, x / sec)
    mean = lambda x, n: F.when(n > 0, x / n).when(x.isNotNull() & n.isNotNull(), 0.0)
    history = F.lower(F.coalesce(F.col(record)["history"], F.lit("")))
    letters = lambda c: (F.length(history) - F.length(F.replace(history, F.lit(c), F.lit("")))).cast("double")
    text = lambda key: F.coalesce(F.col(record)[key], F.lit(""))
    return log.select(
        text("id.orig_h").alias("Src IP"), text("id.orig_p").alias("Src Port"), text("id.resp_h").alias("Dst IP"), text("id.resp_p").alias("Dst Port"), text("proto").alias("Protocol"), text("uid").alias("UID"),
        num("id.resp_p").alias("Destination Port"), (sec * 1_000_000).alias("Flow Duration"), fp.alias("Total Fwd Packets"), bp.alias("Total Backward Packets"), fb.alias("Total Length of Fwd Packets"), bb.alias("Total Length of Bwd Packets"),
        mean(fb, fp).alias("Fwd Packet Length Mean"), mean(bb, bp).alias("Bwd Packet Length Mean"), mean(fb, fp).alias("Avg Fwd Segment Size"), mean(bb, bp).alias("Avg Bwd Segment Size"),
        rate(fb + bb).alias("Flow Bytes/s"), rate(fp + bp).alias("Flow Packets/s"), rate(fp).alias("Fwd Packets/s"), rate(bp).alias("Bwd Packets/s"), mean(fb + bb, fp + bp).alias("Packet Length Mean"), mean(fb + bb, fp + bp).alias("Average Packet Size"),
        F.when(fp > 0, bp / fp).otherwise(0.0).alias("Down/Up Ratio"), fp.alias("Subflow Fwd Packets"), fb.alias("Subflow Fwd Bytes"), bp.alias("Subflow Bwd Packets"), bb.alias("Subflow Bwd Bytes"),
        letters("s").alias("SYN Flag Count"), letters("f").alias("FIN Flag Count"), letters("r").alias("RST Flag Count"),
    )


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Vulnerability findings: a bare JSON list, or an object with ``findings``."""
    finding = "struct<id: string, title: string, severity: string, cvss: double, asset: string, flow: map<string, double>>"
    whole = spark.read.text(path, wholetext=True)
    bare = F.from_json("value", f"array<{finding}>")
    inner = F.from_json("value", f"struct<findings: array<{finding}>>")["findings"]
    return whole.select(F.inline(F.when(F.ltrim("value").startswith("["), bare).otherwise(inner)))


def flow_frame(df: DataFrame, columns: Sequence[str], flow: str = "flow") -> DataFrame:
    """Requests' flow maps as model columns; missing features are null."""
    return df.select("*", *[F.col(flow)[c].alias(c) for c in columns])


def unknown_features(df: DataFrame, allowed: Sequence[str], flow: str = "flow") -> DataFrame:
    """Requests that name features outside the contract."""
    return df.where(F.size(F.array_except(F.map_keys(flow), F.array(*[F.lit(c) for c in allowed]))) > 0)


def alert_documents(df: DataFrame, dataset: str = "tidemark.flow", source: Column | None = None, stamp: Column | None = None, version: str = "1") -> DataFrame:
    """One nested alert document (JSON) per row, by the Elastic Common Schema; absent parts are left out.

    Reads attack_probability, predicted_class, is_attack, recommended_action and,
    where present, the identity columns Src IP, Src Port, Dst IP, Dst Port.
    """
    have = set(df.columns)
    p = F.coalesce(F.col("attack_probability"), F.lit(0.0))
    end = lambda side: F.struct(F.col(f"{side} IP").cast("string").alias("ip"), F.col(f"{side} Port").cast("int").alias("port")) if {f"{side} IP", f"{side} Port"} <= have else F.lit(None)
    doc = F.struct(
        (stamp if stamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("@timestamp"),
        F.struct(
            F.lit("alert").alias("kind"), F.array(F.lit("intrusion_detection"), F.lit("network")).alias("category"), F.coalesce(F.col("recommended_action"), F.lit("alert")).alias("action"),
            F.lit(dataset).alias("dataset"), severity(p).alias("severity"), F.round(p * 100, 2).alias("risk_score"),
        ).alias("event"),
        F.struct(F.col("predicted_class").alias("name")).alias("rule"),
        F.struct(F.round(p, 6).alias("attack_probability"), F.col("is_attack").alias("is_attack"), F.lit(version).alias("model_version")).alias("model"),
        end("Src").alias("source"), end("Dst").alias("destination"),
        F.struct(F.struct((source if source is not None else F.lit(None).cast("string")).alias("path")).alias("file")).alias("log"),
    )
    return df.select(F.to_json(doc, {"ignoreNullFields": "true"}).alias("value"))


def append_alerts(docs: DataFrame, path: str) -> None:
    """Append documents as JSON lines."""
    docs.select("value").write.mode("append").text(path)


def triage(findings: DataFrame, probability: str, anomaly: str, weights: Mapping[str, float], order: str) -> DataFrame:
    """Rank findings by fused risk: severity (or clamped CVSS), model probability, anomaly flag.

    Priority 1 is the highest risk; ties keep the order of ``order``.
    """
    bucket = F.create_map(*[F.lit(x) for kv in {"low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}.items() for x in kv])
    base = F.coalesce(F.when(F.col("cvss").isNotNull(), F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.col("cvss"))) / 10.0), bucket[F.col("severity")], F.lit(0.5))
    total = sum(weights.values())
    risk = (weights["severity"] * base + weights["model"] * F.col(probability) + weights["anomaly"] * F.col(anomaly).cast("double")) / total
    out = findings.withColumn("risk", risk).withColumn("_down", -F.col("risk"))
    return position(out, ["_down", order], name="priority").drop("_down")
