"""Queries of the threshold, ranking and calibration operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import wilson
from tidemark.operators import ranking as rk
from tidemark.plans.registry import Tables, query

LI = """li AS (SELECT l_orderkey, l_suppkey, l_partkey, (round(l_discount * 100) * 10 + round(l_tax * 100)) / 108::DOUBLE AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
 l_returnflag AS label, l_linestatus AS status, year(l_shipdate)::INTEGER AS day FROM lineitem)"""
ROC = LI + """,
ties AS (SELECT score, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM li GROUP BY score),
roc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS n_pos, sum(neg) OVER () AS n_neg FROM ties WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT *, tp / n_pos::DOUBLE AS tpr, fp / n_neg::DOUBLE AS fpr, tp / (tp + fp)::DOUBLE AS precision FROM roc)"""
EV = """ev AS (SELECT event_id, user_id, ts, epoch_us(ts) AS us, event_type AS label, value, least(value / 500::DOUBLE, 1) AS score,
 CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS y, dayofmonth(ts)::INTEGER AS day FROM events)"""


def li(t: Tables) -> DataFrame:
    score = (F.round(F.col("l_discount") * 100) * 10 + F.round(F.col("l_tax") * 100)) / 108.0
    return t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", score.alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("day"))


def ev(t: Tables) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", "user_id", "ts", us.alias("us"), F.col("event_type").alias("label"), "value", F.least(F.col("value") / 500.0, F.lit(1.0)).alias("score"), F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0).alias("y"), F.dayofmonth("ts").alias("day"))


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Doubles rounded to six places, for value hashes."""
    names = names or tuple(c for c, kind in df.dtypes if kind == "double")
    return df.withColumns({c: F.round(c, 6) for c in names})


@query(f"WITH {ROC} SELECT round(score, 6) AS score, pos, neg, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM r")
def roc_points(t: Tables) -> DataFrame:
    return r6(rk.roc_frame(li(t)).select("score", "pos", "neg", "tp", "fp", "tpr", "fpr", "precision"))


@query(f"WITH {ROC} SELECT round(sum(pos / n_pos::DOUBLE * precision), 6) AS average_precision FROM r")
def average_precision(t: Tables) -> DataFrame:
    return r6(rk.average_precision(rk.roc_frame(li(t))))


@query(f"WITH {ROC} SELECT round(sum(pos * ((n_neg - fp) + neg / 2::DOUBLE)) / max(n_pos * n_neg), 6) AS roc_auc FROM r")
def roc_auc(t: Tables) -> DataFrame:
    return r6(rk.roc_auc(rk.roc_frame(li(t))))


@query(f"WITH {ROC} SELECT round(min(score), 6) AS threshold, round(max(tpr), 6) AS tpr, round(max(fpr), 6) AS fpr FROM r WHERE fpr <= 0.1::DOUBLE")
def threshold_at_fpr(t: Tables) -> DataFrame:
    return r6(rk.threshold_at_fpr(rk.roc_frame(li(t)), 0.1))


@query(f"WITH {ROC} SELECT round(greatest(0, max(tpr - fpr)), 6) AS advantage FROM r")
def membership_advantage(t: Tables) -> DataFrame:
    return r6(rk.membership_advantage(rk.roc_frame(li(t))))


@query(f"""WITH {EV}, ties AS (SELECT label, score, sum(CASE WHEN day > 15 THEN 1 ELSE 0 END)::BIGINT AS pos, sum(CASE WHEN day > 15 THEN 0 ELSE 1 END)::BIGINT AS neg FROM ev GROUP BY ALL),
roc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER p AS n_pos, sum(neg) OVER p AS n_neg FROM ties WINDOW w AS (PARTITION BY label ORDER BY score DESC), p AS (PARTITION BY label))
SELECT label, round(sum(pos / n_pos::DOUBLE * tp / (tp + fp)::DOUBLE), 6) AS average_precision, round(sum(pos * ((n_neg - fp) + neg / 2::DOUBLE)) / max(n_pos * n_neg), 6) AS roc_auc FROM roc GROUP BY label""")
def grouped_ap_auc(t: Tables) -> DataFrame:
    roc = rk.roc_frame(ev(t).withColumn("y", F.when(F.col("day") > 15, 1).otherwise(0)), by=["label"])
    return r6(rk.average_precision(roc, ["label"]).join(rk.roc_auc(roc, ["label"]), "label"))


@query(f"""WITH {LI} SELECT day, count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn,
round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS tpr, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6) AS fpr, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision FROM li GROUP BY day""")
def rates_by_day(t: Tables) -> DataFrame:
    return r6(rk.rates_at_threshold(li(t), 0.5, by=["day"]))


@query(f"WITH {LI} SELECT round(avg(CASE WHEN y = 1 THEN (score > 0.5)::INT END), 6) AS tpr, round(avg(CASE WHEN y = 0 THEN (score > 0.5)::INT END), 6) AS fpr FROM li")
def rates_above(t: Tables) -> DataFrame:
    return r6(rk.rates_above(li(t), 0.5))


@query(f"WITH {LI} SELECT label AS true_label, count(*) FILTER (status = 'F') AS \"F\", count(*) FILTER (status = 'O') AS \"O\" FROM li GROUP BY label")
def confusion(t: Tables) -> DataFrame:
    return rk.confusion(li(t), "label", "status", ["F", "O"])


PRED = "CASE WHEN score >= 0.6::DOUBLE THEN 'R' WHEN score >= 0.3::DOUBLE THEN 'A' ELSE 'N' END"
REPORT = f"""WITH {LI}, p AS (SELECT label, {PRED} AS pred FROM li), s AS (SELECT l.label, (SELECT count(*) FROM p WHERE p.label = l.label) AS support, (SELECT count(*) FROM p WHERE p.pred = l.label) AS said,
 (SELECT count(*) FROM p WHERE p.pred = l.label AND p.label = l.label) AS hit FROM (SELECT DISTINCT label FROM p UNION SELECT DISTINCT pred FROM p) l),
f AS (SELECT label, support, coalesce(hit / nullif(said, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall FROM s),
g AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM f)"""


def _pred(t: Tables) -> DataFrame:
    s = F.col("score")
    return li(t).withColumn("pred", F.when(s >= 0.6, "R").when(s >= 0.3, "A").otherwise("N"))


@query(REPORT + " SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM g")
def class_report(t: Tables) -> DataFrame:
    return r6(rk.class_report(_pred(t), "label", "pred"))


@query(REPORT + " SELECT round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM g")
def macro_report(t: Tables) -> DataFrame:
    return r6(rk.macro_report(rk.class_report(_pred(t), "label", "pred")))


@query(f"WITH {LI} SELECT label, count(*) AS support, round(avg((score >= 0.5)::INT), 6) AS detection FROM li WHERE label <> 'N' GROUP BY label")
def class_detection(t: Tables) -> DataFrame:
    return r6(rk.class_detection(li(t), 0.5, "N"))


@query(f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY day, label ORDER BY ts, event_id) AS place FROM ev WHERE label <> 'view')
SELECT day, label, count(*) AS flows, count(*) FILTER (score >= 0.3) AS alerts, min(CASE WHEN score >= 0.3 THEN place END)::INTEGER AS first_alert FROM p GROUP BY day, label""")
def campaigns(t: Tables) -> DataFrame:
    return rk.campaign_outcomes(ev(t), 0.3, "view", "day", ["ts", "event_id"])


@query(f"""WITH {LI}, s AS (SELECT s_nationkey AS service, score, y FROM li JOIN supplier ON s_suppkey = l_suppkey),
g AS (SELECT service, count(*) FILTER (y = 0) AS benign, count(*) FILTER (y = 1) AS attacks, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp FROM s GROUP BY service)
SELECT * EXCLUDE (share), round(share, 6) AS false_alert_share, round(tp / attacks::DOUBLE, 6) AS tpr, round(fp / benign::DOUBLE, 6) AS fpr FROM (SELECT *, fp / sum(fp) OVER ()::DOUBLE AS share FROM g) WHERE benign + attacks >= 500""")
def service_slices(t: Tables) -> DataFrame:
    joined = li(t).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).withColumnRenamed("s_nationkey", "service")
    return r6(rk.service_slices(joined, 0.5, "service", 500))


@query(f"""WITH {LI}, g AS (SELECT day, sum(y)::BIGINT AS k, count(*) AS n FROM li GROUP BY day), p AS (SELECT *, k / n::DOUBLE AS p FROM g)
SELECT day, k, n, round((p + 1.96::DOUBLE ^ 2 / (2 * n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.96::DOUBLE ^ 2 / n), 6) AS low,
 round((p + 1.96::DOUBLE ^ 2 / (2 * n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 1.96::DOUBLE ^ 2 / (4 * n * n))) / (1 + 1.96::DOUBLE ^ 2 / n), 6) AS high FROM p""")
def wilson_by_day(t: Tables) -> DataFrame:
    g = li(t).groupBy("day").agg(F.sum("y").alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return r6(g.withColumns({"low": low, "high": high}))


REL = f"WITH {LI}, b AS (SELECT least(floor(score * 10), 9)::INTEGER AS bin, avg(score) AS confidence, avg(y::DOUBLE) AS observed, count(*) AS n FROM li GROUP BY 1)"


@query(REL + " SELECT bin, round(confidence, 6) AS confidence, round(observed, 6) AS observed, n FROM b")
def reliability(t: Tables) -> DataFrame:
    return r6(rk.reliability(li(t), 10))


@query(REL + " SELECT round(sum(n * abs(confidence - observed)) / sum(n), 6) AS ece, round(max(abs(confidence - observed)), 6) AS mce, (SELECT round(avg((score - y) ^ 2), 6) FROM li) AS brier FROM b")
def calibration_summary(t: Tables) -> DataFrame:
    return r6(rk.calibration_summary(li(t), 10))


COST = f"""WITH {LI}, q AS (SELECT DISTINCT unnest(quantile_cont(score, [x / 20::DOUBLE for x in range(21)])) AS threshold FROM li),
g AS (SELECT threshold, count(*) FILTER (y = 1 AND score >= threshold) / count(*) FILTER (y = 1)::DOUBLE AS tpr, count(*) FILTER (y = 0 AND score >= threshold) / count(*) FILTER (y = 0)::DOUBLE AS fpr FROM li, q GROUP BY threshold),
c AS (SELECT *, 1::DOUBLE * (tpr * 0.01::DOUBLE + fpr * 0.99::DOUBLE) + 500::DOUBLE * (1 - tpr) * 0.01::DOUBLE AS cost FROM g)"""


@query(COST + " SELECT round(threshold, 6) AS threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(cost, 6) AS cost FROM c")
def cost_curve(t: Tables) -> DataFrame:
    return r6(rk.cost_curve(li(t), rk.quantile_grid(li(t), 21), 0.01, 1.0, 500.0))


@query(COST + " SELECT round(threshold, 6) AS threshold, round(cost, 6) AS cost FROM c ORDER BY c.cost, c.threshold LIMIT 1")
def cost_optimal(t: Tables) -> DataFrame:
    return r6(rk.cost_optimal(rk.cost_curve(li(t), rk.quantile_grid(li(t), 21), 0.01, 1.0, 500.0)))


@query("""WITH p AS (SELECT unnest([0.0001, 0.001, 0.01, 0.1, 0.5])::DOUBLE AS prior)
SELECT prior, round(0.9::DOUBLE * prior / (0.9::DOUBLE * prior + 0.01::DOUBLE * (1 - prior)), 6) AS precision, round(100000 * (0.9::DOUBLE * prior + 0.01::DOUBLE * (1 - prior)), 6) AS alerts,
round(100000 * 0.9::DOUBLE * prior, 6) AS true_alerts, round(100000 * (1 - 0.9::DOUBLE) * prior, 6) AS missed FROM p""")
def base_rate_sweep(t: Tables) -> DataFrame:
    priors = t.spark.createDataFrame([(p,) for p in (0.0001, 0.001, 0.01, 0.1, 0.5)], "prior double")
    return r6(rk.prior_sweep(0.9, 0.01, priors, 100000), "precision", "alerts", "true_alerts", "missed")


@query(f"""WITH {ROC}, d AS (SELECT *, 100000 * (tpr * 0.01::DOUBLE + fpr * 0.99::DOUBLE) AS daily FROM r), b AS (SELECT unnest([1000, 10000, 50000])::BIGINT AS budget),
m AS (SELECT budget, arg_max(score, tp + fp) AS score, arg_max(tpr, tp + fp) AS tpr, arg_max(fpr, tp + fp) AS fpr, arg_max(daily, tp + fp) AS daily FROM d, b WHERE daily <= budget GROUP BY budget)
SELECT budget, round(score, 6) AS threshold, round(tpr, 6) AS recall, round(tpr * 0.01 / (tpr * 0.01::DOUBLE + fpr * 0.99::DOUBLE), 6) AS precision, round(tpr * 0.01 / (tpr * 0.01::DOUBLE + fpr * 0.99::DOUBLE) / 0.01::DOUBLE, 6) AS lift, round(daily, 6) AS alerts FROM m""")
def alert_queue(t: Tables) -> DataFrame:
    budgets = t.spark.createDataFrame([(b,) for b in (1000, 10000, 50000)], "budget long")
    return r6(rk.alert_queue(rk.roc_frame(li(t)), budgets, 0.01, 100000))


@query(f"""WITH {ROC}, pts AS (SELECT tpr, fpr FROM r UNION ALL SELECT 0::DOUBLE, 0::DOUBLE), pi AS (SELECT max(n_pos) / (max(n_pos) + max(n_neg))::DOUBLE AS p FROM r),
g AS (SELECT i / 200::DOUBLE AS c, CASE WHEN i IN (0, 200) THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS w FROM range(201) x(i)),
l AS (SELECT c, w, min(c * (1 - p) * fpr + (1 - c) * p * (1 - tpr)) AS loss, least(c * (1 - max(p)), (1 - c) * max(p)) AS triv FROM g, pts, pi GROUP BY c, w)
SELECT round(1 - sum(loss * c * (1 - c) * w) / sum(triv * c * (1 - c) * w), 6) AS h FROM l""")
def h_measure(t: Tables) -> DataFrame:
    return r6(rk.h_measure(rk.roc_frame(li(t))))


@query(f"""WITH {LI} SELECT round(score, 6) AS score, count(*) AS n, sum(count(*)) OVER (ORDER BY score) - (count(*) - 1) / 2::DOUBLE AS rank FROM li GROUP BY li.score""")
def mid_ranks(t: Tables) -> DataFrame:
    return r6(rk.tie_average_rank(li(t), "score"))


@query(f"WITH {EV}, k AS (SELECT y FROM ev ORDER BY score DESC, event_id LIMIT 200) SELECT round(sum(y) / 200::DOUBLE, 6) AS precision, round(sum(y) / (SELECT sum(y) FROM ev)::DOUBLE, 6) AS recall FROM k")
def topk_stats(t: Tables) -> DataFrame:
    return r6(rk.topk_stats(ev(t), 200, [F.desc("score"), F.col("event_id")]))


@query(f"WITH {EV}, m AS (SELECT avg(score) FILTER (y = 1) AS m1, avg(score) FILTER (y = 0) AS m0 FROM ev) SELECT label, count(*) AS n, count(*) FILTER (CASE WHEN y = 1 THEN score <= m0 ELSE score >= m1 END) AS flagged FROM ev, m GROUP BY label")
def label_audit(t: Tables) -> DataFrame:
    return rk.audit_labels(ev(t)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("flagged"))


@query("""WITH b AS (SELECT unnest(range(1, 51)) AS b), d AS (SELECT b, o_totalprice AS v, ((o_orderkey * 2654435761 + b * 40503 * 3 + (o_orderkey % 1009) * b * 7919) % 4294967296) / 4294967296::DOUBLE AS u FROM orders, b),
w AS (SELECT b, v, (u >= 0.36787944117144233)::INT + (u >= 0.7357588823428847)::INT + (u >= 0.9196986029286058)::INT + (u >= 0.9810118431238462)::INT + (u >= 0.9963401531726563)::INT + (u >= 0.9994058151824183)::INT AS w FROM d),
m AS (SELECT b, sum(w * v) / sum(w) AS m FROM w GROUP BY b) SELECT round(quantile_cont(m, 0.05), 4) AS low, round(quantile_cont(m, 0.95), 4) AS high, count(m) AS replicates FROM m""")
def bootstrap_ci(t: Tables) -> DataFrame:
    out = rk.bootstrap_ci(t.orders.select("o_orderkey", F.col("o_totalprice").alias("value")), "o_orderkey", 50, 0.1, 3)
    return out.withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


TREE = """n AS (SELECT n_nationkey AS k, ['region' || n_regionkey, 'nation' || n_nationkey] AS path FROM nation),
p AS (SELECT a.path AS t, b.path AS s FROM customer c JOIN n a ON a.k = c_nationkey JOIN n b ON b.k = (c_nationkey * 7 + c_custkey) % 25)"""


def _tree(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.array(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")), F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"))).alias("path"))
    c = t.customer.select(F.col("c_nationkey").cast("long").alias("k"), ((F.col("c_nationkey") * 7 + F.col("c_custkey")) % 25).alias("k2"))
    said = n.select(F.col("k").alias("k2"), F.col("path").alias("s"))
    return c.join(F.broadcast(n.withColumnRenamed("path", "t")), "k").join(F.broadcast(said), "k2")


@query(f"""WITH {TREE}, x AS (SELECT sum(len(list_intersect(t, s))) AS b, sum(len(s)) AS s, sum(len(t)) AS t FROM p) SELECT round(b / s::DOUBLE, 6) AS precision, round(b / t::DOUBLE, 6) AS recall,
round(2 * (b / s::DOUBLE) * (b / t::DOUBLE) / (b / s::DOUBLE + b / t::DOUBLE), 6) AS f1 FROM x""")
def hierarchy_prf(t: Tables) -> DataFrame:
    return r6(rk.hierarchy_scores(_tree(t), "t", "s"))


KIND = "CASE WHEN t = s THEN 'exact' WHEN t[1] = s[1] THEN 'within' ELSE 'cross' END"


@query(f"WITH {TREE}, k AS (SELECT {KIND} AS kind, count(*) AS n FROM p GROUP BY 1) SELECT kind, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share FROM k")
def error_profile(t: Tables) -> DataFrame:
    kind = F.when(F.col("t") == F.col("s"), "exact").when(F.col("t")[0] == F.col("s")[0], "within").otherwise("cross")
    return r6(rk.shares(_tree(t).withColumn("kind", kind), "kind"))


@query(f"WITH {TREE}, k AS (SELECT {KIND} AS kind, count(*) AS n FROM p GROUP BY 1) SELECT round(sum(n / (SELECT sum(n) FROM k)::DOUBLE * CASE kind WHEN 'cross' THEN 10 WHEN 'within' THEN 3 ELSE 0 END), 6) AS cost FROM k")
def playbook_cost(t: Tables) -> DataFrame:
    kind = F.when(F.col("t") == F.col("s"), "exact").when(F.col("t")[0] == F.col("s")[0], "within").otherwise("cross")
    return r6(rk.playbook_cost(rk.shares(_tree(t).withColumn("kind", kind), "kind"), {"cross": 10, "within": 3}, "kind"))
