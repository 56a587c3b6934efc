"""Queries of the detectors, sequential kernels and classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import models as ml
from tidemark.operators import ranking as rk
from tidemark.plans.ranking_queries import EV, ev, r6
from tidemark.plans.registry import Tables, query
from tidemark.streaming import kernels, scan

NUM = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.lineitem.withColumn("y", (F.col("l_quantity") * F.col("l_discount") > 2).cast("int"))
    return rows.where(F.year("l_shipdate") < 1999), rows.where(F.year("l_shipdate") >= 1999)


@query("""WITH m AS (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, var_pop(l_quantity) AS va, var_pop(l_discount) AS vb, covar_pop(l_quantity, l_discount) AS c FROM lineitem),
s AS (SELECT *, 0.9 * va + 0.1::DOUBLE * (va + vb) / 2 AS p, 0.9 * vb + 0.1::DOUBLE * (va + vb) / 2 AS q, 0.9::DOUBLE * c AS o FROM m),
d AS (SELECT round(sqrt((q * (l_quantity - a) ^ 2 - 2 * o * (l_quantity - a) * (l_discount - b) + p * (l_discount - b) ^ 2) / (p * q - o * o)), 5) AS score FROM lineitem, s) SELECT score, count(*) AS n FROM d GROUP BY score""")
def mahalanobis(t: Tables) -> DataFrame:
    pair = ("l_quantity", "l_discount")
    model = ml.Mahalanobis.fit(t.lineitem, pair)
    return t.lineitem.groupBy(F.round(model.score(pair), 5).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query()
def pca_residual(t: Tables) -> DataFrame:
    width = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"e{i}" for i in range(width)]
    wide = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return r6(wide.select("vec_id", ml.PcaResidual.fit(wide, names, 4).score(names).alias("score")))


@query()
def isolation_forest(t: Tables) -> DataFrame:
    e = ev(t).select("event_id", "value", F.col("user_id").cast("double").alias("user"))
    return ml.IsolationForest.fit(e, ["value", "user"], "event_id", trees=50).transform(e, ["value", "user"])


@query()
def boosted_classifier(t: Tables) -> DataFrame:
    train, test = _split(t)
    bundle = ml.train_bundle(train, test, NUM, "boosted", budgets={"default": 0.01}, maxIter=10, maxDepth=3)
    roc = rk.roc_frame(bundle.score(test).withColumnRenamed("attack_probability", "score"))
    return rk.roc_auc(roc).crossJoin(rk.average_precision(roc))


@query()
def logistic_scores(t: Tables) -> DataFrame:
    train, test = _split(t)
    bundle = ml.train_bundle(train, test, NUM, "logistic", budgets={"default": 0.05})
    return bundle.predict(test, "default").groupBy("predicted_class", "recommended_action").agg(F.count(F.lit(1)).alias("n"))


@query()
def isotonic_calibration(t: Tables) -> DataFrame:
    e = ev(t)
    cal = ml.Calibrator("isotonic").fit(e.where("day <= 15"))
    return r6(e.select("event_id", cal.apply(F.col("score")).alias("p")))


@query()
def adwin(t: Tables) -> DataFrame:
    return scan.keyed_scan(ev(t), "user_id", ["ts", "event_id"], ["value"], kernels.Adwin, "width long, mean double, changed boolean").groupBy("user_id").agg(F.count_if("changed").alias("changes"), F.max("width").alias("width"))


@query()
def p2_quantile(t: Tables) -> DataFrame:
    out = scan.keyed_scan(ev(t), "user_id", ["ts", "event_id"], ["value"], lambda: kernels.P2Quantile(0.95), "q double")
    return out.groupBy("user_id").agg(F.max_by("q", "event_id").alias("q95"))


@query()
def hoeffding_tree(t: Tables) -> DataFrame:
    e = ev(t).withColumns({"x": F.col("score"), "big": (F.col("value") > 60).cast("int")})
    out = scan.keyed_scan(e, "user_id", ["ts", "event_id"], ["value", "x", "big"], lambda: kernels.HoeffdingTree(2, grace=100), "p double", keep=["big"])
    return out.groupBy("user_id").agg(F.avg(((F.col("p") >= 0.5) != (F.col("big") == 1)).cast("double")).alias("error"))


@query()
def adaptive_conformal(t: Tables) -> DataFrame:
    e = ev(t)
    edges = e.where("day <= 10").groupBy("y").agg(F.percentile("score", F.array(*[F.lit(k / 200) for k in range(201)])).alias("q")).collect()
    tables = {r["y"]: list(r["q"]) for r in edges}
    benign, attack = tables[0], [1 - s for s in tables[1]]
    out = scan.keyed_scan(e.where("day > 10"), "user_id", ["ts", "event_id"], ["score", "y"], lambda: kernels.AdaptiveConformal(benign, attack, 0.1, 0.02, 10), "b boolean, a boolean, missed boolean, alpha_b double, alpha_a double")
    return out.groupBy("user_id").agg(F.avg(F.col("missed").cast("double")).alias("missed"))


@query(f"""WITH RECURSIVE {EV}, e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, [abs(y - 0.1::DOUBLE), abs(y - 0.4::DOUBLE), abs(y - 0.9::DOUBLE)] AS l FROM ev),
s AS (SELECT user_id, 1::BIGINT AS n, [1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE] AS h, [1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE] AS f FROM e WHERE n = 1
 UNION ALL SELECT user_id, n + 1, [x / list_sum(h2) for x in h2], [0.98::DOUBLE * x / list_sum(f2) + 0.02::DOUBLE / 3 for x in f2]
 FROM (SELECT s.user_id, s.n, [h[i] * exp(-0.5::DOUBLE * l[i]) for i in [1, 2, 3]] AS h2, [f[i] * exp(-0.5::DOUBLE * l[i]) for i in [1, 2, 3]] AS f2 FROM s JOIN e ON s.user_id = e.user_id AND s.n = e.n))
SELECT user_id, round(sum(list_dot_product(h, l)), 5) AS hedge, round(sum(list_dot_product(f, l)), 5) AS share FROM s JOIN e USING (user_id, n) GROUP BY user_id""")
def fixed_share(t: Tables) -> DataFrame:
    e = ev(t).withColumns({f"l{i}": F.abs(F.col("y") - p) for i, p in enumerate((0.1, 0.4, 0.9))})
    out = scan.keyed_scan(e, "user_id", ["ts", "event_id"], ["l0", "l1", "l2"], lambda: kernels.Experts(3, 0.5, 0.02), "hedge double, share double")
    return out.groupBy("user_id").agg(F.round(F.sum("hedge"), 5).alias("hedge"), F.round(F.sum("share"), 5).alias("share"))


@query(f"""WITH RECURSIVE {EV}, v AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n, log10(greatest(count(*) FILTER (value >= 100), 0.5::DOUBLE) / 2) AS e FROM ev GROUP BY user_id, day),
c AS (SELECT user_id, 0::BIGINT AS n, NULL::INTEGER AS day, -2::DOUBLE AS r, 0::DOUBLE AS t FROM v WHERE n = 1
 UNION ALL SELECT user_id, n, day, least(-0.3::DOUBLE, greatest(-5, r + least(0.15::DOUBLE, greatest(-0.15::DOUBLE, held - r)))), CASE WHEN held = wanted THEN t2 ELSE t END
 FROM (SELECT *, least(-0.3::DOUBLE, greatest(-5, wanted)) AS held FROM (SELECT c.user_id, v.n, v.day, r, t, t + e AS t2, r - 0.6::DOUBLE * e - 0.1::DOUBLE * (t + e) AS wanted FROM c JOIN v ON v.user_id = c.user_id AND v.n = c.n + 1)))
SELECT user_id, day, round(r, 6) AS log_rate FROM c WHERE n > 0""")
def control_loop(t: Tables) -> DataFrame:
    v = ev(t).groupBy("user_id", "day").agg(F.count_if(F.col("value") >= 100).cast("double").alias("volume"))
    return r6(scan.keyed_scan(v, "user_id", ["day"], ["volume"], lambda: kernels.LogRateController(2.0), "log_rate double").select("user_id", "day", "log_rate"))


@query()
def linear_bandit(t: Tables) -> DataFrame:
    e = ev(t).withColumns({"one": F.lit(1.0), "r0": F.lit(0.0), "r1": F.when(F.col("value") > 60, 1.0).otherwise(-0.3)})
    out = scan.keyed_scan(e, "user_id", ["ts", "event_id"], ["one", "score", "r0", "r1"], lambda: kernels.LinearBandit(2, 0.5), "action long, reward double")
    return out.groupBy("user_id").agg(F.sum("reward").alias("reward"), F.sum("action").alias("reviews"))
