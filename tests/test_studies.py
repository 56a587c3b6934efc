import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as md
from tidemark.operators import studies as st


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(900).select("id", (F.col("id") * 37 % 101 / 50.0 - 1).alias("a"), (F.col("id") * 53 % 97 / 48.0 - 1).alias("b"))
    df = df.withColumn("y", (F.col("a") + 0.3 * F.col("b") > 0.1).cast("int"))
    kind = F.when(F.col("y") == 0, "benign").when(F.col("b") > 0, "dos").otherwise("scan")
    return df.withColumn("kind", kind).cache()


@pytest.fixture(scope="module")
def parts(rows):
    return [rows.where(F.col("id") % 3 == k) for k in range(3)]


def test_families_and_curves(parts):
    train, val, test = parts
    r = st.evaluate_family("logistic", train, val, test, ["a", "b"]).first()
    assert r.family == "logistic" and r.average_precision > 0.95 and r.roc_auc > 0.95 and 0 < r["tpr_at_fpr_0.01"] <= 1
    curve = {r.fraction: r for r in st.learning_curve(train, val, test, ["a", "b"], "id", "y", [0.2, 1.0]).collect()}
    assert curve[0.2].rows < curve[1.0].rows == 300 and curve[1.0].average_precision > 0.9


def test_domain_weights(parts):
    train, _, test = parts
    moved = test.withColumn("a", F.col("a") + 0.5)
    weighted, auc = st.domain_ratio(train, moved, ["a", "b"], "id")
    assert weighted.count() == 300 and 0.6 < auc < 1
    high, low = (weighted.where(c).agg(F.avg("weight")).first()[0] for c in ("a > 0.5", "a < -0.5"))
    assert 0 <= low < high <= 20


def test_rewards_surrogates_and_codes(rows, parts):
    train, _, test = parts
    reward = st.reward_model(train.withColumn("seen", F.col("id") % 2 == 0), ["a", "b"], "seen", "y", 10.0, 1.0)
    means = {r.y: r.m for r in reward(test).groupBy("y").agg(F.avg("reward").alias("m")).collect()}
    assert means[1] > 5 > 1 > means[0]
    victim = F.col("y")
    copy = st.surrogate(train.withColumn("answer", victim), ["a", "b"], "answer", "logistic")
    assert copy(test).agg(F.avg(((F.col("attack_probability") >= 0.5) == (victim == 1)).cast("double"))).first()[0] > 0.95
    code = st.pca_encoder(train, ["a", "b"], 1)(test)
    assert code.select(F.size("code")).distinct().collect()[0][0] == 1
    more = st.adversarial_rows(rows, "y", {"a": -1.0}, [0.5, 1.0])
    n = rows.where("y = 1").count()
    assert more.count() == rows.count() + 2 * n and more.where("a = -1 and y = 1").count() >= n


def test_importances_and_interactions(rows):
    imp = st.importance_matrix(rows, ["a", "b"], "id", 2, numTrees=5, maxDepth=3)
    means = {r.feature: r.m for r in imp.groupBy("feature").agg(F.avg("importance").alias("m")).collect()}
    assert imp.count() == 4 and means["a"] > means["b"]
    some = rows.where("id < 60")
    h = {(r.a, r.b): r.h for r in st.interaction_matrix(some.withColumn("c", F.col("a") * 0 + F.col("id") / 60), some.withColumn("c", F.col("id") / 60), ["a", "b", "c"], lambda x: x["a"] * x["b"] + x["c"]).collect()}
    assert len(h) == 3 and h["a", "b"] > 0.5 and h["a", "c"] < 0.05


def test_models_of_a_taxonomy(parts):
    train, _, test = parts
    paths = {"benign": ["benign"], "dos": ["attack", "dos"], "scan": ["attack", "scan"]}
    got = st.models_per_parent(train, test, ["a", "b"], paths, "kind")
    assert got.count() == test.count() and got.agg(F.avg((F.col("predicted") == F.col("kind")).cast("double"))).first()[0] > 0.9


def test_deployment_is_stored_whole(spark, parts, tmp_path):
    train, val, test = parts
    bundle = st.build_deployment(train, val, ["a", "b"], "id", "kind", str(tmp_path), canaries=10)
    again = md.Bundle.load(f"{tmp_path}/bundle")
    canaries = spark.read.parquet(f"{tmp_path}/canaries")
    gap = again.score(canaries.drop("attack_probability").withColumnRenamed("id", "k")).join(canaries.withColumnRenamed("attack_probability", "p"), F.col("k") == F.col("id"))
    assert canaries.count() == 10 and gap.agg(F.max(F.abs(F.col("p") - F.col("attack_probability")))).first()[0] < 1e-9
    assert spark.read.parquet(f"{tmp_path}/exemplars").groupBy("kind").count().count() == 3 and spark.read.parquet(f"{tmp_path}/reference").count() == 2
    assert set(bundle.thresholds) == {"default"}
