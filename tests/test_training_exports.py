import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import context as cx
from tidemark.operators import training as tr
from tidemark.sources import exports as xp
from tidemark.sources import synthetic as sy


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select("id", (F.col("id") % 30 / 15.0 - 1).alias("a"), (F.col("id") % 7 / 3.5 - 1).alias("b"), (F.col("id") % 3).alias("site"))
    return df.withColumn("y", (F.col("a") + 0.3 * F.col("b") > 0.1).cast("int")).cache()


def accuracy(df, p):
    return df.agg(F.avg(((p >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]


def test_descent_and_its_private_form(rows):
    w = tr.gradient_descent(rows, ["a", "b"], steps=40, rate=3.0)
    assert accuracy(rows, tr.probability(w, ["a", "b"])) > 0.95
    private = tr.gradient_descent(rows, ["a", "b"], steps=30, rate=3.0, clip=0.5, noise=1.0)
    assert accuracy(rows, tr.probability(private, ["a", "b"])) > 0.85 and private != w
    assert tr.gradient_descent(rows.limit(0), ["a"]) == [0.0, 0.0]


def test_federated_sharded_and_robust(rows):
    w = tr.federated_rounds(rows, "site", ["a", "b"], 4, rate=0.5, order="id")
    assert accuracy(rows, tr.probability(w, ["a", "b"])) > 0.9
    models = tr.sharded_models(rows, "site", ["a", "b"], epochs=2, rate=0.5, order="id")
    assert sorted(models) == ["0", "1", "2"] and accuracy(rows, tr.ensemble_probability(models, ["a", "b"])) > 0.85
    hard = rows.withColumn("y", F.when(F.col("site") == 2, 1 - F.col("y")).otherwise(F.col("y")))
    _, share = tr.group_dro(hard, "site", ["a", "b"], rounds=2, steps=5)
    assert max(share, key=share.get) == 2
    penalty = {r.site: r.penalty for r in tr.irm_penalty(hard, "site", tr.logit(w, ["a", "b"])).collect()}
    assert penalty[2] > penalty[0]


def test_secure_sum_survives_dropouts():
    v = {f"s{i}": [float(i), -1.5 * i] for i in range(5)}
    assert tr.secure_sum(v, 3) == [10.0, -15.0]
    assert tr.secure_sum(v, 3, dropped=["s4", "s0"]) == [6.0, -9.0]
    assert tr.secure_sum(v, 4, dropped=["s4", "s0"]) is None


def test_density_and_clusters(spark):
    df = spark.range(300).select("id", (F.col("id") % 2 * 10 + F.col("id") % 10 / 10).alias("a"), (F.col("id") % 7 / 7).alias("b"))
    odd = df.unionByName(spark.createDataFrame([(999, 5.0, 30.0)], "id long, a double, b double"))
    assert tr.mixture_score(df, odd, ["a", "b"], 2).orderBy(F.desc("score")).first().id == 999
    assert tr.kernel_density_score(df, odd, "id", ["a", "b"], 0.5).orderBy(F.desc("score")).first().id == 999
    assert tr.choose_k(df, ["a"], [2, 3, 5])[0] == 2


def test_optimal_tree_against_enumeration(spark):
    data = [(a, b, c, int((a and b) or c and not a)) for a, b, c in itertools.product((False, True), repeat=3) for _ in range(3)]
    df = spark.createDataFrame(data, "a boolean, b boolean, c boolean, y int")
    tree, value, proven = tr.optimal_tree(df, ["a", "b", "c"], "y", 0.01, 2)
    assert proven and tree.predicate == 0 and value == pytest.approx(0.04)
    stump, value, _ = tr.optimal_tree(df, ["a", "b", "c"], "y", 0.5, 3)
    assert stump.predicate is None and value == pytest.approx(1.0)


def test_tree_bounds_hold():
    rng = np.random.default_rng(0)

    def grow(d):
        return (float(rng.normal()),) if d == 0 else (int(rng.integers(2)), float(rng.normal()), grow(d - 1), grow(d - 1))

    trees = [grow(3) for _ in range(5)]
    value = lambda x: sum(tr.tree_bounds(t, x, x)[0] for t in trees)
    for _ in range(50):
        x = rng.normal(size=2)
        low, high = tr.ensemble_bounds(trees, x - 0.3, x + 0.3)
        assert all(low - 1e-9 <= value(x + rng.uniform(-0.3, 0.3, 2)) <= high + 1e-9 for _ in range(20))
        r = tr.certified_radius(trees, x.tolist(), 0.0, [1, 1], [1, 1])
        assert all((value(x + rng.uniform(-r, r, 2)) >= 0) == (value(x) >= 0) for _ in range(20))


def test_synthetic_data_keeps_its_structure(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("a")).withColumn("b", ((F.col("a") + 1) % 3).cast("int"))
    net = tr.BayesNet.fit(df, {"a": None, "b": "a"}, 3)
    out = net.sample(spark, 2000, 1)
    assert out.where("b <> (a + 1) % 3").count() == 0 and out.select("a").distinct().count() == 3
    noisy = tr.BayesNet.fit(df, {"a": None, "b": "a"}, 3, epsilon=1.0)
    assert all(abs(sum(s) - 1) < 1e-9 for t in noisy.table.values() for s in t.values())


def test_generators(spark):
    f = sy.flows(spark, 5000)
    shares = {r.Label: r.n / 5000 for r in f.groupBy("Label").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(shares["BENIGN"] - 0.8) < 0.03 and len(shares) == 5 and f.select("Day").distinct().count() == 5
    best = cx.beacons(sy.beacon_events(spark), ["src", "dst"], "t", 8).orderBy(F.desc("score")).first()
    assert (best.src, best.period, best.score) == ("10.0.0.250", 60.0, 1.0)
    a = sy.adapt_foreign(sy.foreign_flows(spark, 100)).where("`Flow Duration` > 0").first()
    assert a["Flow Packets/s"] > 0


def test_exports(spark, tmp_path):
    slices = spark.createDataFrame([("DoS", 10, 0.5), ("Web Attack", 0, 0.0), ("Infiltration", 0, 0.0), ("odd", 5, 1.0)], "label string, support long, detection double")
    layer = xp.navigator_layer(slices, "x")
    assert [(t["techniqueID"], t["score"]) for t in layer["techniques"]] == [("T1190", 0.0), ("T1499", 50.0)]
    inc = spark.createDataFrame([("DoS", 0, 3, 4, 0.9), ("odd", 5, 5, 1, 2.0)], "label string, first_pos int, last_pos int, alerts long, peak double")
    bundle = xp.stix_bundle(inc, "me", "2024-01-01T00:00:00Z")
    assert bundle == xp.stix_bundle(inc, "me", "2024-01-01T00:00:00Z") and [o["type"] for o in bundle["objects"]] == ["identity", "attack-pattern", "incident", "relationship", "incident"]
    assert "pps|gte: 100" in xp.sigma_rules({"flood": [("pps", "ge", 100.0)]})["flood"]
    df = spark.range(20).withColumn("part", F.when(F.col("id") < 5, "test").otherwise("train"))
    manifest = xp.write_splits(df, str(tmp_path), "s", "id")
    assert manifest["parts"]["test"]["rows"] == 5 and xp.load_split(spark, str(tmp_path), "s", "train").count() == 15
    with pytest.raises(ValueError):
        xp.write_splits(df.unionByName(df.limit(1).withColumn("part", F.lit("train"))), str(tmp_path), "bad", "id")
    assert json.load(open(xp.track_run(str(tmp_path / "r"), "n", {"a": 1}, {"m": 0.5})))["metrics"] == {"m": 0.5}
