"""Exports of results: STIX bundles, ATT&CK layers, Sigma rules, split parts, run records."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cleaning import Clause, content_digest, overlap

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public URL namespace

#: ATT&CK techniques of attack classes (fixed values).
TECHNIQUES = {
    "DDoS": ("T1498", "Network Denial of Service", "Impact"), "DoS": ("T1499", "Endpoint Denial of Service", "Impact"), "PortScan": ("T1046", "Network Service Discovery", "Discovery"),
    "Bot": ("T1071", "Application Layer Protocol", "Command and Control"), "Infiltration": ("T1190", "Exploit Public-Facing Application", "Initial Access"), "Web Attack": ("T1190", "Exploit Public-Facing Application", "Initial Access"),
    "FTP-Patator": ("T1110", "Brute Force", "Credential Access"), "SSH-Patator": ("T1110", "Brute Force", "Credential Access"), "Heartbleed": ("T1212", "Exploitation for Credential Access", "Credential Access"),
}


def technique_table(spark) -> DataFrame:  # noqa: ANN001
    """class, technique, name, tactic: a dimension of fixed size."""
    return spark.createDataFrame([(c, *t) for c, t in TECHNIQUES.items()], "class string, technique string, name string, tactic string")


def by_technique(slices: DataFrame) -> DataFrame:
    """Support-weighted detection per technique; classes without one are left out, support 0 gives 0. Slices: label, support, detection."""
    dim = F.broadcast(technique_table(slices.sparkSession))
    joined = slices.join(dim, F.col("label") == F.col("class"))
    return joined.groupBy("technique", "name", "tactic").agg(F.sum("support").alias("support"), F.coalesce(F.sum(F.col("support") * F.col("detection")) / F.nullif(F.sum("support"), F.lit(0)), F.lit(0.0)).alias("detection"))


def navigator_layer(slices: DataFrame, name: str) -> dict:
    """A layer for the ATT&CK Navigator; one row per technique reaches the driver."""
    rows = by_technique(slices).orderBy("technique").collect()
    return {
        "name": name, "versions": {"layer": "4.5"}, "domain": "enterprise-attack", "gradient": {"colors": ["#ff6666", "#ffe766", "#8ec843"], "minValue": 0, "maxValue": 100},
        "techniques": [{"techniqueID": r["technique"], "score": round(100 * r["detection"], 1), "comment": f"{r['support']} flows"} for r in rows],
    }


def stix_bundle(incidents: DataFrame, identity: str, created: str) -> dict:
    """A deterministic STIX 2.1 bundle of incidents (label, first_pos, last_pos, alerts, peak): equal rows give equal ids."""
    make = lambda kind, key, **fields: {"type": kind, "spec_version": "2.1", "id": f"{kind}--{uuid.uuid5(_SPACE, f'{identity}/{kind}/{key}')}", "created": created, "modified": created, **fields}
    who = make("identity", identity, name=identity, identity_class="system")
    objects, patterns = [who], {}
    for r in incidents.orderBy("first_pos", "label").collect():
        label = r["label"]
        if label in TECHNIQUES and label not in patterns:
            code, name, _ = TECHNIQUES[label]
            patterns[label] = make("attack-pattern", code, name=name, external_references=[{"source_name": "mitre-attack", "external_id": code}])
            objects.append(patterns[label])
        key = f"{label}/{r['first_pos']}/{r['last_pos']}"
        seen = make("incident", key, name=f"{label} ({r['alerts']} alerts)", created_by_ref=who["id"], confidence=int(round(100 * min(1.0, max(0.0, r["peak"])))))
        objects.append(seen)
        if label in patterns:
            objects.append(make("relationship", key, relationship_type="uses", source_ref=seen["id"], target_ref=patterns[label]["id"]))
    return {"type": "bundle", "id": f"bundle--{uuid.uuid5(_SPACE, json.dumps([o['id'] for o in objects]))}", "objects": objects}


def sigma_rules(rules: Mapping[str, Sequence[Clause]]) -> dict[str, str]:
    """One Sigma rule (YAML text) per rule."""
    words = {"ge": "gte", "le": "lte", "eq": ""}
    out = {}
    for name, clauses in rules.items():
        lines = [f"    {c}{'|' + words[op] if words[op] else ''}: {v:g}" for c, op, v in clauses]
        out[name] = "\n".join([f"title: {name}", f"id: {uuid.uuid5(_SPACE, 'sigma/' + name)}", "status: experimental", "logsource:", "  category: network_connection", "detection:", "  selection:", *lines, "  condition: selection", "level: medium", ""])
    return out


def write_splits(df: DataFrame, root: str, strategy: str, key: str, part: str = "part") -> dict:
    """Write a split by part after checking that no key is in two; returns the manifest (rows and digest per part)."""
    names = sorted(r[0] for r in df.select(part).distinct().collect())
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if overlap(df.where(F.col(part) == a), df.where(F.col(part) == b), key).first()["shared"]:
                raise ValueError(f"parts {a} and {b} share keys")
    df.write.mode("overwrite").partitionBy(part).parquet(f"{root}/{strategy}")
    return {"strategy": strategy, "parts": {n: content_digest(df.where(F.col(part) == n)).first().asDict() for n in names}}


def load_split(spark, root: str, strategy: str, part: str) -> DataFrame:  # noqa: ANN001
    """One part; the filter prunes the others' files."""
    return spark.read.parquet(f"{root}/{strategy}").where(F.col("part") == part).drop("part")


def track_run(folder: str, name: str, params: Mapping, metrics: Mapping[str, float]) -> str:
    """Record a run as one JSON file; returns its path."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{name}-{uuid.uuid4().hex[:12]}.json")
    with open(path, "w") as f:
        json.dump({"name": name, "time": time.time(), "params": dict(params), "metrics": dict(metrics)}, f, sort_keys=True)
    return path
