from pyspark.sql import functions as F

from tidemark.operators import explain as xp


def line(x):
    return 0.6 * x["a"] + 0.3 * x["b"] + 0.0 * x["c"]


def frame(spark):
    return spark.createDataFrame([(i, float(i % 4), float(i % 3), float(i % 5), int(i % 4 >= 2)) for i in range(60)], "id long, a double, b double, c double, y int")


CENTRE = {"a": 0.0, "b": 0.0, "c": 0.0}


def test_attributions_are_faithful(spark):
    df = frame(spark)
    got = {(r.id, r.feature): round(r.contribution, 9) for r in xp.occlusion(df, "id", "abc", CENTRE, line).collect()}
    assert got[3, "a"] == 1.8 and got[2, "b"] == 0.6 and got[4, "c"] == 0.0
    d = xp.deletion_test(df, "id", "abc", CENTRE, line, 1).first()
    assert d.top_drop > d.random_drop > 0


def test_recourse_moves_as_little_as_it_can(spark):
    rows = {r.id: r for r in xp.recourse(frame(spark), "abc", ["a", "b"], CENTRE, line, 1.0, 3).collect()}
    assert rows[0].moved == [] and rows[3].moved == ["a"] and rows[3].escaped
    assert all(r.escaped for r in rows.values())
    stuck = xp.recourse(frame(spark), "abc", ["c"], CENTRE, line, 1.0, 2).where("id = 3").first()
    assert stuck.moved == [] and not stuck.escaped


def test_anchor_finds_the_decisive_bin(spark):
    df = frame(spark).select(F.col("a").cast("int").alias("ba"), F.col("b").cast("int").alias("bb"), "y")
    a = xp.anchor(df, {"bb": 1, "ba": 3}, "y", 1, 0.7, 2, 5)
    assert a["features"] == ["ba"] and a["precision"] == 1.0 and a["coverage"] == 0.25
    assert xp.anchor(df, {"bb": 1}, "y", 1, 0.99, 2, 1000)["features"] == []


def test_interaction_is_zero_for_sums_and_one_for_products(spark):
    df = frame(spark).withColumns({"a": F.col("a") - 1.5, "b": F.col("b") - 1})
    points = df.limit(20)
    assert xp.h_statistic(df, points, "a", "b", "abc", line).first().h < 1e-6
    assert xp.h_statistic(df, points, "a", "b", "abc", lambda x: x["a"] * x["b"]).first().h > 0.99


def test_probes(spark):
    df = frame(spark)
    assert xp.monotone_violations(df, "abc", ["a"], [2.0], line).first().violations == 0.0
    assert xp.monotone_violations(df.where("a > 0"), "abc", ["a"], [2.0], lambda x: -x["a"]).first().violations == 1.0
    scored = lambda d: d.withColumn("score", F.col("a") / 3)
    got = {r.relation: (r.flip_rate, r.max_delta) for r in xp.metamorphic(df, {"same": lambda d: d, "up": lambda d: d.withColumn("a", F.col("a") + 3)}, "id", scored, 0.5).collect()}
    assert got["same"] == (0.0, 0.0) and got["up"] == (0.5, 1.0)
    bad = xp.poison(df, "id", "y", {"c": 99.0}, 0.2)
    assert bad.where("poisoned and y = 0 and c = 99").count() == 6 and bad.count() == 66
    planted = df.unionByName(spark.createDataFrame([(100 + i, 50.0, 50.0, 0.0, 1) for i in range(4)], df.schema))
    assert {r.id for r in xp.spectral_scores(planted, "abc").orderBy(F.desc("score")).limit(4).collect()} == {100, 101, 102, 103}


def test_budgeted_probabilities_and_retraining(spark):
    df = spark.createDataFrame([(1000.0,)] + [(1.0,)] * 99, "w double")
    p = xp.priority_probabilities(df, "w", 0.1, 0.001)
    assert abs(p.agg(F.sum("probability")).first()[0] - 10) < 0.01 and p.agg(F.max("probability")).first()[0] == 1.0
    psi = spark.createDataFrame([(i, v) for i, v in enumerate((0.3, 0.3, 0.1, 0.3, 0.3, 0.0))], "b int, psi double")
    assert [r.b for r in xp.retrain_schedule(psi, "b", 0.25, 3).collect()] == [0, 3]
    assert xp.retrain_schedule(psi, "b", 0.9, 3).count() == 0


def test_slices_influence_and_merging(spark):
    df = spark.range(400).select("id", (F.col("id") % 2 == 0).alias("even"), (F.col("id") % 3 == 0).alias("third"), ((F.col("id") % 6 == 0).cast("double") + (F.col("id") % 7) / 100).alias("loss"))
    top = xp.beam_slices(df, {"even": F.col("even"), "third": F.col("third"), "odd": ~F.col("even")}, "loss", 2, 2, 20).first()
    assert top.slice == "even & third" and top.n == 67
    rows = spark.createDataFrame([(i, float(i % 10 - 5), int(i % 10 >= 5)) for i in range(100)] + [(999, -5.0, 1)], "id long, a double, y int")
    inf = {r.id: r for r in xp.influence(rows, rows.where("id < 999"), "id", ["a"], [1.0, 0.0]).collect()}
    assert max(inf, key=lambda i: inf[i].self_influence) == 999
    m = xp.merge_cascade(df.select("id", (F.col("id") / 400).alias("s1"), (F.col("id") % 5 / 5).alias("s2")), "s1", "s2", F.col("id") >= 300).orderBy("id").collect()
    assert max(r.merged for r in m[:300]) < min(r.merged for r in m[300:]) and [r.merged for r in m[:300]] == sorted(r.merged for r in m[:300])
    a, b = (spark.range(300).select("id", (F.col("id") % 10 + shift).cast("double").alias("v")) for shift in (0, 2))
    d = xp.independent_difference(a, b, "id", "v", 60, 0.1, 1).first()
    assert 0.5 < d.low < 2 < d.high < 3.5 and d.p == 0.0


def test_tuning_and_folds(spark):
    from tidemark.operators import models as ml

    rows = spark.range(300).select("id", (F.col("id") % 20 / 20.0).alias("a"), (F.col("id") % 20 >= 12).cast("int").alias("y"))
    best, scores = ml.tune(rows.where("id % 3 > 0"), rows.where("id % 3 = 0"), ["a"], [{"kind": "logistic"}, {"kind": "logistic", "maxIter": 0}])
    assert best == {"kind": "logistic"} and scores[0] == 1.0
    oof = ml.out_of_fold(rows, "id", ["a"])
    assert oof.count() == 300 and oof.where("attack_probability >= 0.5 and y = 0 or attack_probability < 0.5 and y = 1").count() < 30
    kinds = spark.range(200).select(F.when(F.col("id") < 150, "ok").when(F.col("id") < 175, "far").otherwise("near").alias("k"), F.when((F.col("id") >= 150) & (F.col("id") < 175), 50.0).otherwise(F.col("id") % 10).alias("a"), F.lit("train").alias("part"))
    assert ml.leave_one_class_out(kinds, "k", "ok", ["a"], 0.01) == [("far", 1.0), ("near", 0.2)]  # the ends of 0..9 tie at the threshold
