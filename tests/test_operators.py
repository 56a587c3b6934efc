"""Hand-valued cases, empty inputs, single classes and ties."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.operators import cleaning as cl
from tidemark.operators import context as cx
from tidemark.operators import drift as dr
from tidemark.operators import governance as gv
from tidemark.operators import inference as nf
from tidemark.operators import learning as ln
from tidemark.operators import models as ml
from tidemark.operators import ranking as rk
from tidemark.operators import sketches as sk
from tidemark.operators.cumulative import cumulative, position, ranged

SCORED = list(zip((0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9), (0, 0, 0, 0, 1, 1, 1, 1), strict=True))


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(SCORED, "score double, y int")


def one(df):
    return df.first().asDict()


def test_rates_by_hand(scored):
    r = one(rk.rates_at_threshold(scored, 0.65))
    assert (r["tp"], r["fn"], r["fp"], r["tn"], r["tpr"], r["precision"]) == (3, 1, 0, 4, 0.75, 1.0)
    nothing = one(rk.rates_at_threshold(scored.limit(0), 0.5))
    assert nothing["tpr"] == nothing["precision"] == 0.0


def test_roc_of_perfect_tied_and_single_class(spark, scored):
    roc = rk.roc_frame(scored)
    assert one(rk.roc_auc(roc))["roc_auc"] == 1.0 and one(rk.average_precision(roc))["average_precision"] == 1.0
    assert one(rk.threshold_at_fpr(roc, 0.0)) == {"threshold": 0.6, "tpr": 1.0, "fpr": 0.0}
    tied = rk.roc_frame(spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, y int"))
    assert one(rk.roc_auc(tied))["roc_auc"] == 0.5 and one(rk.threshold_at_fpr(tied, 0.5))["threshold"] == math.inf
    alone = rk.roc_frame(scored.where("y = 1"))
    assert one(rk.roc_auc(alone))["roc_auc"] is None and one(rk.h_measure(alone))["h"] == 0.0


def test_class_report_by_hand(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "t string, p string")
    r = {x.label: x for x in rk.class_report(df, "t", "p").collect()}
    assert (r["a"].precision, r["a"].recall, round(r["a"].f1, 6)) == (1.0, 0.5, 0.666667)


def test_calibration_by_hand(spark):
    df = spark.createDataFrame([(0.9, 0)] * 10, "score double, y int")
    assert round(one(rk.calibration_summary(df, 10))["ece"], 9) == 0.9
    b = spark.createDataFrame([(1.0, 1), (0.0, 0)], "score double, y int")
    assert one(rk.calibration_summary(b, 10))["brier"] == 0.0


def test_service_slices_by_hand(spark):
    rows = list(zip([22] * 4 + [80] * 4, (0, 0, 1, 1, 0, 0, 1, 1), (0.6, 0.1, 0.9, 0.8, 0.2, 0.3, 0.7, 0.1), strict=True))
    df = spark.createDataFrame(rows, "port int, y int, score double").withColumn("service", sc.service_of(F.col("port")))
    r = {x.service: x for x in rk.service_slices(df, 0.5, "service", 1).collect()}
    assert (r["ssh"].tpr, r["ssh"].fpr, r["ssh"].false_alert_share, r["http"].tpr, r["http"].fpr) == (1.0, 0.5, 1.0, 0.5, 0.0)


def test_silent_campaigns_and_first_alerts(spark):
    rows = [("Thu", "X", 0.2, 1), ("Thu", "BENIGN", 0.95, 2), ("Thu", "X", 0.9, 3), ("Thu", "X", 0.85, 4), ("Fri", "Y", 0.1, 5)]
    df = spark.createDataFrame(rows, "day string, label string, score double, i int")
    r = {x.label: x for x in rk.campaign_outcomes(df, 0.8, "BENIGN", "day", ["i"]).collect()}
    assert (r["X"].flows, r["X"].alerts, r["X"].first_alert, r["Y"].first_alert) == (3, 2, 2, None)


def test_running_sums_over_ranges(spark):
    """Keys with a long tail, few keys, and one key: sums are exact, and no range of the long table holds many of its rows."""
    rows = [(g, float(v) ** 9, 1) for g in "ab" for v in range(700)] + [("c", 5.0, 7)]
    df = spark.createDataFrame(rows, "g string, k double, n int")
    up = {(r.g, r.k): r.cum_n for r in cumulative(df, "k", ["n"], by=["g"]).collect()}
    down = {(r.g, r.k): r.cum_n for r in cumulative(df, "k", ["n"], descending=True, by=["g"]).collect()}
    assert all(up[g, float(v) ** 9] == v + 1 and down[g, float(v) ** 9] == 700 - v for g in "ab" for v in range(700)) and up["c", 5.0] == 7
    sizes = [r["count"] for r in ranged(df.where("g = 'a'"), "k").groupBy("_range").count().collect()]
    assert len(sizes) > 200 and max(sizes) <= 12
    one = {r.k: r.cum_n for r in cumulative(df.where("g = 'a'").select("k", "n"), "k", ["n"]).collect()}
    assert one == {float(v) ** 9: v + 1 for v in range(700)}


def test_places_in_an_order(spark):
    rows = [(float((i * 7919) % 50) if i % 11 else None, i) for i in range(900)]
    df = spark.createDataFrame(rows, "x double, i int")
    want = {r[1]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    assert {r.i: r.pos for r in position(df, ["x", "i"]).collect()} == want
    assert position(df.limit(0), ["x", "i"]).count() == 0


def test_cleaning_of_a_defective_frame(spark):
    inf = math.inf
    rows = [("a", "1.1.1.1", 80, 100, 1000.0, 8192, "BENIGN"), ("a", "1.1.1.1", 80, 100, 1000.0, 8192, "BENIGN"), ("b", "2.2.2.2", 80, 5, inf, 256, "DoS Hulk"), ("c", "3.3.3.3", 80, 50, 500.0, 256, "Web Attack \u0096 XSS"), ("d", "4.4.4.4", 53, 2, 200.0, -1, "PortScan")]
    df = spark.createDataFrame(rows, "` Flow ID` string, `Source IP` string, ` Destination Port` int, `Flow Duration` int, ` Flow Bytes/s` double, `Init_Win_bytes_forward` int, ` Label` string")
    out = cl.clean(df, "Label", ["Flow Duration", "Flow Bytes/s", "Init_Win_bytes_forward"], ["Flow ID", "Source IP"], {"Web Attack - XSS": "Web Attack"})
    got = sorted((r["Label"], r["label_binary"], r["Flow Bytes/s"], r["Init_Win_bytes_forward"]) for r in out.collect())
    assert got == [("BENIGN", 0, 1000.0, 8192.0), ("DoS Hulk", 1, None, 256.0), ("PortScan", 1, 200.0, -1.0), ("Web Attack", 1, 500.0, 256.0)]
    assert "Flow ID" not in out.columns
    assert [r["name"] for r in cl.quality_gate(out.limit(0), ["Label"], "Label", ["BENIGN"]).collect()] == ["rows"]


def test_rules_ignore_nulls_and_absent_columns(spark):
    df = spark.createDataFrame([(500.0, 3), (500.0, 1), (50.0, 3), (None, 3)], "pps double, syn int")
    out = cl.rule_matrix(df, {"flood": [("pps", "ge", 100.0), ("syn", "ge", 2.0)], "gone": [("nope", "ge", 0.0)]})
    assert [(r.rule_flood, r.rule_gone, r.rule_score) for r in out.collect()] == [(True, False, 0.5), (False, False, 0.0), (False, False, 0.0), (False, False, 0.0)]


def test_as_of_context_excludes_the_instant(spark):
    s = 1_000_000
    df = spark.createDataFrame([("a", 0, "x", 80), ("b", s, "y", 443), ("a", 2 * s, "y", 443), ("b", 3 * s, "z", 22), ("a", 4 * s, "z", 22)], "src string, t long, dst string, port int")
    got = {(r.src, r.t): (r.ctx_events, r.ctx_dst, r.ctx_port) for r in cx.as_of_context(df, "src", "t", 60 * s, ["dst", "port"]).collect()}
    assert got["a", 4 * s] == (2, 2, 2) and [got[k][0] for k in (("a", 0), ("b", s), ("a", 2 * s), ("b", 3 * s))] == [0, 0, 1, 1]
    ties = spark.createDataFrame([("a", 5), ("a", 5)], "src string, t long")
    assert [r.ctx_events for r in cx.as_of_context(ties, "src", "t", 60, []).collect()] == [0, 0]
    edge = spark.createDataFrame([("a", 0), ("a", 60)], "src string, t long")
    assert [sorted(r.ctx_events for r in cx.as_of_context(edge, "src", "t", k, []).collect()) for k in (60, 59)] == [[0, 1], [0, 0]]


def test_beacons_and_scans(spark):
    even = spark.createDataFrame([("a", "b", 60 * i) for i in range(10)] + [("c", "d", i) for i in (0, 1)], "s string, d string, t long")
    (r,) = cx.beacons(even, ["s", "d"], "t", 8).collect()
    assert (r.score, r.cv, r.period, r.events) == (1.0, 0.0, 60.0, 10)
    wide = spark.createDataFrame([("s", f"10.0.0.{i}", 445) for i in range(25)] + [("v", "h", 1024 + i) for i in range(30)], "s string, d string, p int")
    got = {x.s: (x.kind, x.fanout) for x in cx.scans(wide, "s", "d", "p", 20).collect()}
    assert got == {"s": ("horizontal", 25), "v": ("vertical", 30)}


def test_lateral_chain_by_hand(spark):
    edges = [("203.0.113.5", "10.0.0.5"), ("10.0.0.5", "10.0.0.20"), ("10.0.0.20", "10.0.0.50"), ("10.0.0.50", "10.0.0.51"), ("10.0.0.5", "10.0.0.5")]
    e = cx.adjacency(spark.createDataFrame(edges, "a string, b string"), "a", "b")
    (r,) = cx.lateral_chains(e, 6, 3).collect()
    assert r.hosts == 5 and r.path[0] == "203.0.113.5" and r.path[-1] == "10.0.0.51"


@pytest.mark.parametrize(("text", "tolerance", "want"), [("DBBDBBBD", 2, [[0, 3], [7]]), ("DBBDBBBD", 3, [[0, 3, 7]]), ("DDPP", 5, [[0, 1], [2, 3]])])
def test_incident_islands(spark, text, tolerance, want):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(text)], "i int, c string")
    found = {}
    for r in cx.incidents(df, ["i"], F.col("c") != "B", "c", tolerance).orderBy("pos").collect():
        found.setdefault(r.incident, []).append(r.pos)
    assert list(found.values()) == want


def test_conformal_and_discoveries_by_hand(spark):
    null = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.3, 0.4)], "s double")
    test = spark.createDataFrame([(i, x) for i, x in enumerate((0.35, 0.5, 0.05))], "i int, s double")
    assert [round(r.p, 9) for r in nf.conformal_pvalues(null, test, "i", "s").orderBy("i").collect()] == [0.4, 0.2, 1.0]
    for ps, q, want in (((0.005, 0.01, 0.5, 0.5), 0.05, [1, 1, 0, 0]), ((0.001, 0.03, 0.035, 0.9), 0.05, [1, 1, 1, 0]), ((0.9, 0.8), 0.05, [0, 0])):
        df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
        assert [int(r.selected) for r in nf.benjamini_hochberg(df, "p", q).orderBy("i").collect()] == want
    sets = spark.createDataFrame([(0.05,), (0.5,), (0.95,)], "p double").select(*[c.alias(n) for c, n in zip(sc.conformal_set(F.col("p"), 0.3, 0.3), "bac", strict=True)]).collect()
    assert [(r.b, r.a, r.c) for r in sets] == [(True, False, "auto_clear"), (False, False, "review"), (False, True, "auto_alert")]
    # one above the textbook rank: index ceil(level * (n - 1)) of n = 9 at alpha 0.2 is 8
    nine = spark.createDataFrame([(float(i),) for i in range(9)], "s double")
    assert one(nf.conformal_quantile(nine, "s", 0.2))["tau"] == 8.0 and one(nf.conformal_quantile(nine.limit(0), "s", 0.2))["tau"] == math.inf


def test_survival_by_hand(spark):
    table = lambda rows: nf.kaplan_meier(nf.life_table(spark.createDataFrame(rows, "t int, e int"), "t", "e")).orderBy("time").collect()
    assert [round(r.survival, 6) for r in table([(1, 1), (2, 1), (3, 1), (4, 1)])] == [0.75, 0.5, 0.25, 0.0]
    assert [(r.time, round(r.survival, 4)) for r in table([(2, 1), (3, 0), (4, 1), (5, 0), (5, 0)])] == [(2, 0.8), (4, 0.5333)]


def test_sequential_tests_by_hand(spark):
    up, low = sc.wald_boundaries(0.01, 0.10)
    assert (round(up, 6), round(low, 6)) == (round(math.log(90), 6), round(math.log(0.10 / 0.99), 6))
    rolled = nf.rolling_rate(spark.createDataFrame([("a", i, e) for i, e in enumerate((1, 0, 0, 0))], "k string, i int, e int"), ["k"], ["i"], "e", 2)
    assert [r.rate for r in rolled.orderBy("i").collect()] == [1, 0.5, 0, 0]
    m = nf.np_admissible_count(100, 0.05, 0.1)
    tail = lambda k: sum(math.comb(100, j) * 0.05**j * 0.95 ** (100 - j) for j in range(k + 1))
    assert tail(m) <= 0.1 < tail(m + 1) and nf.np_admissible_count(5, 0.05, 0.1) is None


def test_drift_by_hand(spark):
    x = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    assert one(dr.psi(x, x, ["x"]))["psi"] == 0.0 and one(dr.psi(x, x.select((F.col("x") + 1e7).alias("x")), ["x"]))["drift"] == "major"
    assert one(dr.ks(x, x, ["x"]))["ks"] == 0.0 and dr.ks(x, x.select(F.lit(None).cast("double").alias("x")), ["x"]).count() == 0
    s = spark.range(600).select(F.lit("k").alias("k"), F.col("id"), F.when(F.col("id") < 300, 0.0).otherwise(1.0).alias("v"))
    assert 300 <= one(dr.page_hinkley(s, ["k"], ["id"], F.col("v"), 0.005, 5.0))["alarm"] <= 360
    assert one(dr.page_hinkley(s.where("id < 300"), ["k"], ["id"], F.col("v"), 0.005, 5.0))["alarm"] is None
    e = spark.range(700).select(F.lit("k").alias("k"), F.col("id"), F.when(F.col("id") < 400, F.col("id") % 20 == 0).otherwise(F.col("id") % 2 == 0).alias("e"))
    assert one(dr.ddm(e, ["k"], ["id"], F.col("e"), min_samples=50))["drift"] >= 400
    assert one(dr.ddm(e.where("id < 400"), ["k"], ["id"], F.col("e"), min_samples=50))["drift"] is None


def test_sketch_bounds(spark):
    df = spark.range(20_000).select((F.col("id") % 997).alias("k"))
    w, d = sk.count_min_size(0.01, 0.01)
    true = {r.k: r.n for r in df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    est = {r.k: r.estimate for r in sk.count_min_query(sk.count_min(df, "k", w, d), df.distinct(), "k", w, d).collect()}
    assert all(true[k] <= est[k] <= true[k] + 0.01 * 20_000 for k in true)
    for n in (50, 5000, 20_000):
        got = one(sk.cardinality(sk.registers(spark.range(n).withColumnRenamed("id", "k"), "k", 12), 12))["estimate"]
        assert abs(got - n) <= 0.06 * n


def test_trimmed_mean_and_krum(spark):
    df = spark.createDataFrame([(str(i), [float(v)]) for i, v in enumerate((0, 1, 2, 3, 100))], "s string, v array<double>")
    u = ln.explode_updates(df, "s", "v")
    assert one(ln.trimmed_mean(u, 1))["value"] == 2.0 and one(ln.trimmed_mean(u, 9))["value"] == 2.0
    assert [r.site for r in ln.krum(u, 1).where("chosen").collect()] in (["1"], ["2"])


def test_ledger_detects_every_fault(spark):
    df = spark.createDataFrame([("L", i, '{"b": 1, "a": %d}' % i, f"t{i}") for i in range(6)], "l string, i int, p string, t string")
    chain = gv.seal(df, "l", "i", "p", "t").cache()
    assert gv.canonical_json('{"b":1, "a":0}') == gv.canonical_json('{"a": 0,"b":1}')
    assert one(gv.verify(chain))["ok"]
    edited = chain.withColumn("payload", F.when(F.col("seq") == 2, "{}").otherwise(F.col("payload")))
    assert (one(gv.verify(edited))["bad_seq"], one(gv.verify(edited))["failure"]) == (2, "payload")
    removed = one(gv.verify(chain.where("seq <> 3")))
    assert (removed["bad_seq"], removed["failure"]) == (4, "sequence")
    head = one(gv.verify(chain))["head"]
    pins = spark.createDataFrame([("L", 6, head)], "ledger string, count long, head string")
    assert one(gv.verify(chain, pins))["ok"] and one(gv.verify(chain.where("seq < 5"), pins))["failure"] == "truncated"
    leaves = [r.entry_hash for r in chain.orderBy("seq").collect()]
    for n in (1, 2, 5, 6):
        root = gv.merkle_root(leaves[:n])
        assert all(gv.verify_inclusion(leaves[i], gv.inclusion_proof(leaves[:n], i), root) for i in range(n))
        assert n == 1 or not gv.verify_inclusion(leaves[0], gv.inclusion_proof(leaves[:n], 1), root)
    assert one(gv.merkle_levels(chain, "ledger", "seq", "entry_hash", 3))["root"] == gv.merkle_root(leaves)


def test_weak_labels_recover_good_rules(spark):
    rows = [(int(i % 10 < 3), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "y int, i int").select("y", *[(F.when(F.col("y") == 1, (F.col("i") * p) % 97 < 80).otherwise((F.col("i") * p) % 97 < 8)).alias(f"r{p}") for p in (31, 57, 83)])
    votes = [c for c in df.columns if c != "y"]
    rates = ln.fit_label_model(ln.vote_patterns(df, votes), votes, 0.3)
    assert all(t > 0.7 and f < 0.2 for t, f in rates.values())
    found = df.withColumn("p", ln.naive_posterior(rates, 0.3))
    assert one(found.agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")).alias("a")))["a"] > 0.93


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1234.5,), (-0.00123,), (math.inf,)], "x double")
    got = [tuple(r) for r in df.select(sc.round_significant(F.col("x"), 2), sc.bucket_of(F.col("x"), [0, 10]), sc.severity(F.col("x")), sc.clamp(F.col("x"), 0, 1)).collect()]
    assert got == [(None, 0, None, None), (0.0, 2, 0, 0.0), (1200.0, 3, 100, 1.0), (-0.0012, 1, 0, 0.0), (math.inf, 0, 100, 1.0)]
    ring = spark.createDataFrame([(-1.5,), (2.25,)], "x double").select(sc.dequantize(sc.quantize(F.col("x"), 100.0, 10**6), 100.0, 10**6).alias("x")).collect()
    assert [r.x for r in ring] == [-1.5, 2.25]


def test_bundle_round_trip_and_contract(spark, tmp_path):
    rows = spark.range(400).select((F.col("id") % 40 / 40.0).alias("a"), (F.col("id") % 7 / 7.0).alias("b"), (F.col("id") % 40 >= 25).cast("int").alias("y"), F.col("id"))
    bundle = ml.train_bundle(rows.where("id % 4 > 0"), rows.where("id % 4 = 0"), ["a", "b"], "logistic", budgets={"strict": 0.01})
    out = bundle.predict(rows, "strict")
    assert one(out.agg(F.avg((F.col("is_attack") == (F.col("y") == 1)).cast("double")).alias("x")))["x"] > 0.9
    bundle.save(str(tmp_path / "b"))
    again = ml.Bundle.load(str(tmp_path / "b")).predict(rows, "strict")
    assert again.select("id", "attack_probability").exceptAll(out.select("id", "attack_probability")).count() == 0
    assert bundle.score(rows.select("id", "a")).where("attack_probability is null").count() == 0
    tuned = bundle.predict(rows.withColumn("service", F.lit("ssh")), "strict", "service", spark.createDataFrame([("ssh", 2.0)], "service string, threshold double"))
    assert tuned.where("is_attack").count() == 0


def test_calibrators_and_detectors(spark):
    df = spark.createDataFrame([(i / 100, int(i * 7 % 100 < i)) for i in range(100)], "score double, y int")
    for method in ("isotonic", "platt"):
        p = [r.p for r in df.select("score", ml.Calibrator(method).fit(df).apply(F.col("score")).alias("p")).orderBy("score").collect()]
        assert all(0 <= x <= 1 for x in p) and all(a <= b + 1e-12 for a, b in zip(p, p[1:], strict=False))
    x = spark.range(500).select(F.col("id"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 * 2).cast("double").alias("b")).unionByName(spark.createDataFrame([(999, 0.0, 40.0)], "id long, a double, b double"))
    normal = x.where("id < 999")
    for model in (ml.Mahalanobis.fit(normal, ["a", "b"], 0.01), ml.PcaResidual.fit(normal, ["a", "b"], 1)):
        assert x.select("id", model.score(["a", "b"]).alias("s")).orderBy(F.desc("s")).first().id == 999
    forest = ml.IsolationForest.fit(normal, ["a", "b"], "id", trees=50, size=128)
    assert forest.transform(x, ["a", "b"]).orderBy(F.desc("score")).first().id == 999
