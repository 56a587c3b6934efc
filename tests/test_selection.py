import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import closed_forms as cf
from tidemark.functions import designs as dg
from tidemark.functions import features as ft
from tidemark.operators import context as cx
from tidemark.operators import selection as sl
from tidemark.operators import summaries as sm
from tidemark.sources import synthetic as sy
from tidemark.streaming.kernels import EpsilonGreedy

COLUMNS = ["Destination Port", "Flow Duration", "Flow Bytes/s", "Total Fwd Packets", "Packet Length Mean", "SYN Flag Count", "Init_Win_bytes_forward", "Fwd IAT Mean", "Fwd Header Length", "Weird"]


def test_families_and_tiers():
    assert [ft.family_of(c) for c in COLUMNS] == ["other", "timing/IAT", "flow rates", "volume/counts", "packet size", "TCP flags", "header/window/bulk", "timing/IAT", "header/window/bulk", "other"]
    assert [ft.tier_of(c) for c in COLUMNS] == ["handshake", "complete", "in_flight", "complete", "in_flight", "complete", "handshake", "in_flight", "complete", "in_flight"]
    sets = ft.tier_sets(COLUMNS)
    assert sets["handshake"] == ["Destination Port", "Init_Win_bytes_forward"] and sets["complete"] == COLUMNS and len(sets["in_flight"]) == 6
    assert len(ft.LABELS) == 15 and len(ft.attack_labels()) == 14 and ft.BENIGN not in ft.attack_labels()
    assert ft.display_name("numeric__Flow Duration") == "Flow Duration" and ft.display_name("x") == "x"
    assert ft.model_columns(COLUMNS, True) == (COLUMNS[1:], ["Destination Port"]) and ft.model_columns(COLUMNS)[1] == []
    assert ft.family_parents(["Flow Duration", "Weird", "Fwd IAT Mean", "Idle Max"]) == [-1, -1, 0, 2]
    assert ft.leaked(["numeric__Flow ID", "Destination Port"], ["Flow ID"]) == ["numeric__Flow ID", "Destination Port"]
    assert ft.signs(["a", "n__b"], ["b"]) == [0, 1] and ft.rate_columns(COLUMNS) == ["Flow Bytes/s"] and ft.timing_columns(COLUMNS) == ["Flow Duration", "Fwd IAT Mean"]
    tiers = ft.priced_tiers(COLUMNS, {"timing/IAT": 0.2, "other": 0.1, "TCP flags": 5.0})
    assert tiers[0] == (["other"], ["Destination Port", "Weird"], 0.1) and tiers[1][2] == pytest.approx(0.3) and len(tiers[-1][1]) == len(COLUMNS)


def test_designs():
    assert dg.normal_tail(0) == 0.5 and dg.normal_tail(1.96) == pytest.approx(0.025, abs=1e-4)
    assert 0.93 < dg.interval_coverage(lambda k, n: cf.wilson(k, n), 0.2, 60) < 0.975
    assert 0.9 < dg.prior_mean_coverage(lambda k, n: cf.jeffreys(k, n), 2.0, 30.0, 40, 20) < 0.99
    rng = np.random.default_rng(1)
    fpr = 1 - np.sort(rng.random((4000, 200)), axis=1)[:, ::-1][:, 12]  # the rate of the 13th largest
    assert dg.violation_chance(200, 0.05, 12) == pytest.approx((fpr > 0.05).mean(), abs=0.03)
    assert dg.certification_floor(0.001, 0.95) == 2995 and dg.prior_from_weights([2, 0], [0.5, 0.5]) == [1, 0] and dg.prior_from_weights([-1, 0], [0.3, 0.7]) == [0.3, 0.7]
    assert dg.sequence_error(400, 300, 0.05, 10.0) <= 0.05 < dg.sequence_error(400, 300, 0.9, 10.0)
    assert dg.mean_latency(10, 0.01, 0.001) == pytest.approx(1.5 * 0.011) and dg.mean_latency(2000, 0.01, 0.001) == math.inf
    assert dg.blended_latency(1, 10, 0.2) == 3 and dg.search_seconds(4, 4) == 4
    assert [dg.cycle_length(s) for s in ([], [1], [1, 2, 2], [1, 2, 1, 2], [3, 1, 2])] == [0, 1, 1, 2, 3]
    assert [dg.top_negatives(k, n) for k, n in ((0, 5), (9, 5), (3, 5), (2, 0))] == [1, 5, 3, 1]
    edges = dg.public_edges(4, -1.0, math.e**3 - 1)
    assert len(edges) == 5 and dg.levels(edges) == 5 and edges[-1] == pytest.approx(3)
    model = dg.believed_label_model([0.9], [0.5], 0.2)[0]
    assert sum(v[0] for v in model.values()) == pytest.approx(1) and model[1][1] == pytest.approx(0.45)
    specs = dg.draw_specs({"a": [1, 2], "b": "xyz"}, 10)
    assert len(specs) == 6 == len({tuple(s.values()) for s in specs}) and dg.draw_specs({"a": [1, 2], "b": "xyz"}, 2) == specs[:2]


def test_updates_of_sites():
    x = [[1.0, 2.0], [3.0, 2.0], [100.0, -50.0]]
    assert dg.aggregate_updates("mean", x[:2], [1, 3]) == [2.5, 2.0] and dg.aggregate_updates("median", x, [1, 1, 1]) == [3.0, 2.0]
    assert dg.aggregate_updates("trimmed", x, [1, 1, 1], trim=0.34) == [3.0, 2.0] and dg.aggregate_updates("krum", x, [1, 1, 1], 1) in x[:2]
    assert dg.sign_flip([1, -2], 3) == [-3, 6] and len(dg.gaussian_update(5, 1.0)) == 5
    total = [sum(v) for v in zip(dg.encode_update([1.0, 2.0], 1, 1e6), dg.encode_update([4.0, -1.0], 3, 1e6), strict=True)]
    assert dg.decode_update(total, 1e6) == pytest.approx([3.25, -0.25])
    rng = random.Random(3)
    masks = dg.pair_masks({s: dg.dh_keypair(rng) for s in "abcd"}, 1, 3)
    assert [sum(m[i] for m in masks.values()) % ((1 << 61) - 1) for i in range(3)] == [0, 0, 0] and len({tuple(m) for m in masks.values()}) == 4


def test_two_sample_kernels(spark):
    rng = np.random.default_rng(2)
    a, b = (spark.createDataFrame([(i, float(u), float(v)) for i, (u, v) in enumerate(rng.multivariate_normal([0, 0], [[1, r], [r, 1]], 300))], "id long, u double, v double") for r in (0.0, 0.9))
    stat, p, gamma = sl.mmd_permutation_test(a, b, ["u", "v"], "id", 100, 200)
    assert p <= 0.02 and stat > 0 and gamma > 0
    _, same, _ = sl.mmd_permutation_test(a, a, ["u", "v"], "id", 50, 200)
    assert same > 0.3
    alone = sl.per_feature_mmd(a, b, ["u", "v"], "id", 200)
    assert max(alone.values()) < stat  # each column by itself looks the same
    x = rng.normal(size=(30, 2))
    kernel, first = sl._kernel(x, 0.7), np.arange(30) < 12
    k = lambda p, q: np.exp(-0.7 * ((p[:, None] - q[None, :]) ** 2).sum(axis=2))
    want = (k(x[:12], x[:12]).sum() - 12) / 132 + (k(x[12:], x[12:]).sum() - 18) / 306 - 2 * k(x[:12], x[12:]).mean()
    assert sl.split_mmd2(kernel, first[None, :])[0] == pytest.approx(want)


def test_evasion_and_watermarks(spark):
    df = spark.createDataFrame([(i, 1.0 + i, 2.0) for i in range(5)], "id long, a double, b double")
    model = lambda x: x["a"] * 2 + x["b"]
    got = sl.search_evasion(df, ["a", "b"], ["a"], model, "id", 0.5, 40).collect()
    assert all(2 * r.a + 2 - 1.0 <= r.evaded < 2 * r.a + 2 - 0.5 for r in got)
    assert all(r.evaded == 2 * r.a + 2 for r in sl.search_evasion(df, ["a", "b"], ["a"], model, "id", 0.0, 5).collect())
    keys = sl.watermark_keys(spark, 6, 400, 8.0, 1)
    assert keys.count() == 400 and 150 < keys.where("owner_label = 1").count() < 250
    assert sl.watermark_accuracy(keys, "owner_label", "owner_label").first()[0] == 1.0


def test_inflation_takes_the_best_factors(spark):
    df = spark.createDataFrame([(i, 1.0 + i, float((i * 7) % 5), 2.0) for i in range(6)], "id long, a double, b double, c double")
    model = lambda x: x["a"] * (3 - x["b"]) + F.pow(x["c"] - 4, 2)
    plain = lambda a, b, c: a * (3 - b) + (c - 4) ** 2
    for r in sl.inflate(df, ["a", "b", "c"], ["c", "a"], model, [1.5, 2.0, 3.0]).collect():
        c = min((1.0, 1.5, 2.0, 3.0), key=lambda m: (plain(r.a, r.b, r.c * m), m)) * r.c
        assert r.evaded == pytest.approx(min(plain(r.a * m, r.b, c) for m in (1.0, 1.5, 2.0, 3.0)))
    assert df.select(sl.complexity(["a", "c"]).alias("n")).where("n < 2.3").count() == 1
    assert {r.b: r.entries for r in sl.grade_counts(df, "b").collect()} == {0.0: 2, 2.0: 1, 4.0: 1, 1.0: 1, 3.0: 1}


def test_fixtures_have_what_they_plant(spark):
    window = sy.correlated_window(spark, 4000, 3, 0.6)
    assert sl.dependence_strength(window, ["x0", "x1", "x2"]).first()["mean"] == pytest.approx(0.6, abs=0.05)
    scored = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 2 == 1, 0.9).otherwise(0.1).alias("score"))
    stream = sy.host_stream(scored, "y", "score", "id", 1000, 0.3, 600)
    assert stream.count() == 1000 and stream.where("pos < 600 and y = 1").count() == 0 and 80 < stream.where("y = 1 and score = 0.9").count() < 160
    graph = sy.graph_events(spark)
    assert [r.src for r in cx.scans(graph, "src", "dst", "port", 40).collect()] == ["10.0.1.250"]
    chains = cx.lateral_chains(cx.adjacency(graph.where("port = 3389"), "src", "dst"), 5, 3).collect()
    assert [len(r.path) for r in chains] == [5]


def test_greedy_bandit_settles_on_the_better_action():
    bandit = EpsilonGreedy(0.1, 2, 1)
    taken = [bandit.step(0.2, 0.8)[0] for _ in range(400)]
    assert 0.85 < np.mean(taken[50:]) < 1 and EpsilonGreedy(0.0, 3).step(1.0, 2.0, 3.0) == (0, 1.0)


def test_digest_and_counters(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(size=20_000), [1e6]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (math.nan,)], "v double").repartition(7)
    shares = [0.001, 0.25, 0.5, 0.99, 0.999]
    for r in sm.tdigest_quantiles(df, "v", shares).collect():
        place = (values <= r["quantile"]).mean()
        assert abs(place - r.share) < 0.02 * math.sqrt(r.share * (1 - r.share)) + 2e-4
    assert math.isnan(sm.TDigest().quantile(0.5))
    keys = ["hot"] * 3000 + ["warm"] * 1500 + [f"k{i}" for i in range(4000)]
    random.Random(1).shuffle(keys)
    got = {r["key"]: r["count"] for r in sm.misra_gries(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k string").repartition(5), "k", 9).collect()}
    assert len(got) <= 9 and 3000 - 850 <= got["hot"] <= 3000 and 1500 - 850 <= got["warm"] <= 1500


def test_autoencoder_scores_unusual_rows_higher(spark):
    rng = np.random.default_rng(5)
    t = rng.normal(size=600)
    rows = [(i, float(x), float(2 * x + e), float(-x)) for i, (x, e) in enumerate(zip(t, rng.normal(scale=0.1, size=600), strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    model = sm.Autoencoder.fit(df, ["a", "b", "c"], "id", hidden=1, sample=400, epochs=500, rate=0.02)
    normal = df.select(F.avg(model.score())).first()[0]
    odd = spark.createDataFrame([(1.0, -2.0, 1.0)], "a double, b double, c double").select(model.score()).first()[0]
    assert normal < 0.15 and odd > 5 * normal
    v = np.array([0.3, 0.5, -0.2])
    z = (v - model.mean) / model.scale
    want = ((np.tanh(z @ model.inner + model.inner_bias) @ model.outer + model.outer_bias - z) ** 2).mean()
    assert spark.createDataFrame([tuple(map(float, v))], "a double, b double, c double").select(model.score()).first()[0] == pytest.approx(want)
