"""Queries of the inference, survival, sequential and drift operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import mix32

from tidemark.functions import scalar as sc
from tidemark.operators import context as cx
from tidemark.operators import drift as dr
from tidemark.operators import inference as nf
from tidemark.plans.context_queries import EPI
from tidemark.plans.ranking_queries import EV, LI, ev, li, r6
from tidemark.plans.registry import Tables, query

CAL = f"""WITH {EV}, cal AS (SELECT * FROM ev WHERE day <= 15 AND y = 0), tst AS (SELECT * FROM ev WHERE day > 15)"""


@query(f"""WITH {EV}, s AS (SELECT label, score, row_number() OVER (PARTITION BY label ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM ev)
SELECT label, round(min(score) FILTER (i >= ceil(least(1, ceil((n + 1) * 0.9::DOUBLE) / n::DOUBLE) * (n - 1) - 1e-9::DOUBLE)), 6) AS tau, n FROM s GROUP BY label, n""")
def conformal_quantiles(t: Tables) -> DataFrame:
    return r6(nf.conformal_quantile(ev(t), "score", 0.1, ["label"]))


PV = CAL + ", pv AS (SELECT event_id, score, y, (1 + (SELECT count(*) FROM cal WHERE cal.score >= tst.score)) / (1 + (SELECT count(*) FROM cal))::DOUBLE AS p FROM tst)"


def _pvalues(t: Tables) -> DataFrame:
    e = ev(t)
    return nf.conformal_pvalues(e.where("day <= 15 and y = 0"), e.where("day > 15"), "event_id", "score")


@query(PV + " SELECT event_id, round(score, 6) AS score, round(p, 6) AS p FROM pv")
def conformal_pvalues(t: Tables) -> DataFrame:
    return r6(_pvalues(t))


BH = PV + """, k AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pv), c AS (SELECT max(p) AS cut FROM k WHERE p <= k * 0.9::DOUBLE / m)"""


@query(BH + " SELECT event_id, coalesce(p <= cut, FALSE) AS selected FROM pv, c")
def bh_select(t: Tables) -> DataFrame:
    return nf.benjamini_hochberg(_pvalues(t), "p", 0.9).select("event_id", "selected")


@query(BH + """ SELECT round(count(*) FILTER (p <= cut AND y = 0) / greatest(count(*) FILTER (p <= cut), 1)::DOUBLE, 6) AS fdp, round(count(*) FILTER (p <= cut AND y = 1) / count(*) FILTER (y = 1)::DOUBLE, 6) AS power, count(*) FILTER (p <= cut) AS selected FROM pv, c""")
def bh_outcome(t: Tables) -> DataFrame:
    chosen = nf.benjamini_hochberg(_pvalues(t), "p", 0.9).join(ev(t).select("event_id", "y"), "event_id")
    return r6(nf.false_discovery(chosen, "selected", "y"))


@query(f"""WITH {LI} SELECT round(score, 6) AS score, score <= 0.7::DOUBLE AS benign, 1 - score <= 0.6::DOUBLE AS attack, CASE WHEN 1 - score <= 0.6::DOUBLE AND NOT score <= 0.7::DOUBLE THEN 'auto_alert' WHEN score <= 0.7::DOUBLE AND NOT 1 - score <= 0.6::DOUBLE THEN 'auto_clear' ELSE 'review' END AS action, count(*) AS n FROM li GROUP BY ALL""")
def conformal_actions(t: Tables) -> DataFrame:
    b, a, action = sc.conformal_set(F.col("score"), 0.7, 0.6)
    return li(t).select(F.round("score", 6).alias("score"), b.alias("benign"), a.alias("attack"), action.alias("action")).groupBy("score", "benign", "attack", "action").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LI}, s AS (SELECT y, score <= 0.7::DOUBLE AS b, 1 - score <= 0.6::DOUBLE AS a FROM li) SELECT round(avg((CASE WHEN y = 1 THEN a ELSE b END)::INT), 6) AS coverage, round(avg((a AND NOT b)::INT), 6) AS alert, round(avg((b AND NOT a)::INT), 6) AS clear, round(avg((a AND b)::INT), 6) AS "both", round(avg((NOT a AND NOT b)::INT), 6) AS empty FROM s""")
def conformal_shares(t: Tables) -> DataFrame:
    return r6(nf.conformal_shares(li(t), "score", "y", 0.7, 0.6))


KM = f"""WITH {EPI}, t AS (SELECT label, time, sum(event)::BIGINT AS d, count(*) - sum(event)::BIGINT AS c, count(*) AS m FROM ep GROUP BY label, time),
lt AS (SELECT label, time, d, c, (sum(m) OVER (PARTITION BY label ORDER BY time DESC))::BIGINT AS at_risk FROM t),
km AS (SELECT *, CASE WHEN max((d = at_risk)::INT) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk::DOUBLE) ELSE 0 END) OVER w) END AS s, sum(CASE WHEN d < at_risk THEN d / (at_risk * (at_risk - d))::DOUBLE ELSE 0 END) OVER w AS v FROM lt WINDOW w AS (PARTITION BY label ORDER BY time)),
cv AS (SELECT *, CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(-(1.96 * sqrt(v) / ln(s)))) ELSE s END AS low, CASE WHEN s > 0 AND s < 1 THEN pow(s, exp(1.96 * sqrt(v) / ln(s))) ELSE s END AS high FROM km WHERE d > 0)"""


def _km(t: Tables) -> DataFrame:
    e = cx.episodes(ev(t), "day", "label", ["ts", "event_id"], F.col("value") >= 150, 10)
    return nf.kaplan_meier(nf.life_table(e, "time", "event", ["label"]), by=["label"])


@query(KM + " SELECT label, time, d, c, at_risk, round(s, 6) AS survival, round(low, 6) AS low, round(high, 6) AS high FROM cv")
def kaplan_meier(t: Tables) -> DataFrame:
    return r6(_km(t))


@query(KM + " SELECT label, coalesce(min(CASE WHEN s <= 0.5 THEN time END)::DOUBLE, 'inf'::DOUBLE) AS median FROM cv GROUP BY label")
def median_survival(t: Tables) -> DataFrame:
    return nf.median_survival(_km(t), ["label"])


@query(KM + """, a AS (SELECT label, s * (least(coalesce(lead(time) OVER w, 8), 8) - least(time, 8)) + CASE WHEN row_number() OVER w = 1 THEN least(time, 8) ELSE 0 END AS a FROM cv WINDOW w AS (PARTITION BY label ORDER BY time))
SELECT label, round(sum(a), 6) AS rmst FROM a GROUP BY label""")
def restricted_mean(t: Tables) -> DataFrame:
    return r6(nf.restricted_mean(_km(t), 8, ["label"]))


@query(f"""WITH {EPI}, p AS (SELECT time, sum(event) AS d, count(*) AS m, sum(CASE WHEN label = 'error' THEN event ELSE 0 END) AS da, count(*) FILTER (label = 'error') AS ma FROM ep GROUP BY time),
r AS (SELECT *, sum(m) OVER (ORDER BY time DESC) AS n, sum(ma) OVER (ORDER BY time DESC) AS na FROM p),
s AS (SELECT sum(da)::BIGINT AS o, sum(d * na / n::DOUBLE) AS e, sum(d * (na / n::DOUBLE) * (1 - na / n::DOUBLE) * (n - d) / (n - 1)::DOUBLE) AS v FROM r WHERE d > 0 AND n > 1)
SELECT o AS observed, round(e, 6) AS expected, round((o - e) ^ 2 / v, 6) AS chi2 FROM s""")
def logrank(t: Tables) -> DataFrame:
    e = cx.episodes(ev(t), "day", "label", ["ts", "event_id"], F.col("value") >= 150, 10)
    return r6(nf.logrank(e, "time", "event", "label", "error"))


HASH = "((o_orderkey * 2654435761) % 4294967296) / 4294967296::DOUBLE"


@query(f"""WITH p AS (SELECT o_totalprice AS v, least(1, greatest(1e-9, CASE o_orderpriority WHEN '1-URGENT' THEN 0.5 ELSE 0.2 END))::DOUBLE AS pi, {HASH} AS u FROM orders)
SELECT round(sum(v / pi), 2) AS total, round(sum(v ^ 2 * (1 - pi) / pi ^ 2) / 1e9, 2) AS variance, round(sum(v) / avg(pi), 2) AS naive FROM p WHERE u < pi""")
def horvitz_thompson(t: Tables) -> DataFrame:
    pi = F.when(F.col("o_orderpriority") == "1-URGENT", 0.5).otherwise(0.2)
    u = mix32(F.col("o_orderkey")) / float(1 << 32)
    out = nf.horvitz_thompson(t.orders.where(u < pi), F.col("o_totalprice"), pi)
    return out.select(F.round("total", 2).alias("total"), F.round(F.col("variance") / 1e9, 2).alias("variance"), F.round("naive", 2).alias("naive"))


@query("""WITH s AS (SELECT o_orderpriority, count(*) AS n, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1) SELECT o_orderpriority, n, round(sd, 4) AS sd, round(least(1, 500 * n * sd / sum(n * sd) OVER () / n), 6) AS probability FROM s""")
def neyman(t: Tables) -> DataFrame:
    out = nf.stratified_probabilities(t.orders, "o_orderpriority", 500, "o_totalprice")
    return out.select("o_orderpriority", "n", F.round("sd", 4).alias("sd"), F.round("probability", 6).alias("probability"))


@query(f"WITH {LI}, r AS (SELECT *, rank() OVER (ORDER BY score DESC) AS k FROM li) SELECT label, count(*) AS n FROM r WHERE k <= 1000 GROUP BY label")
def greedy_topk(t: Tables) -> DataFrame:
    return nf.greedy_topk(li(t), "score", 1000).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT documents.doc_id, least(n_chars / 5000::DOUBLE, 1) AS f, quality FROM documents LEFT JOIN labels USING (doc_id)), a AS (SELECT count(*) AS n, avg(f - quality) AS b, var_samp(f - quality) AS v, avg(quality) AS my, var_samp(quality) AS vy FROM d WHERE quality IS NOT NULL),
b AS (SELECT count(*) AS m, avg(f) AS mf, var_samp(f) AS vf FROM d WHERE quality IS NULL), z AS (SELECT 1.959963984540054::DOUBLE AS z)
SELECT round(mf - b, 6) AS ppi, round(mf - b - z * sqrt(vf / m + v / n), 6) AS ppi_low, round(mf - b + z * sqrt(vf / m + v / n), 6) AS ppi_high, round(my, 6) AS classical, round(z * sqrt(vy / n), 6) AS classical_half, round(mf, 6) AS naive, round(vy / v, 6) AS gain FROM a, b, z""")
def ppi_mean(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.least(F.col("n_chars") / 5000.0, F.lit(1.0)).alias("f")).join(t.labels, "doc_id", "left")
    return r6(nf.ppi_mean(d.where("quality is not null"), d.where("quality is null"), "quality", "f"))


OPE = f"""WITH {LI}, w AS (SELECT (l_orderkey % 2)::INT AS a, y::DOUBLE AS r, 0.3::DOUBLE + 0.4::DOUBLE * score AS p0, CASE WHEN score >= 0.5::DOUBLE THEN 0.9::DOUBLE ELSE 0::DOUBLE END AS p1, score AS rh FROM li),
i AS (SELECT *, CASE WHEN CASE a WHEN 1 THEN p1 ELSE 1 - p1 END = 0 THEN 0 ELSE CASE a WHEN 1 THEN p1 ELSE 1 - p1 END / CASE a WHEN 1 THEN p0 ELSE 1 - p0 END END AS w FROM w)"""


@query(OPE + " SELECT round(avg(w * r), 6) AS ips, round(sum(w * r) / sum(w), 6) AS snips, round(avg(p1 * rh), 6) AS dm, round(avg(p1 * rh + w * a * (r - rh)), 6) AS dr, round(sum(w) ^ 2 / sum(w * w), 3) AS ess FROM i")
def ope_values(t: Tables) -> DataFrame:
    s = F.col("score")
    w = li(t).select((F.col("l_orderkey") % 2).cast("int").alias("a"), F.col("y").cast("double").alias("r"), (0.3 + 0.4 * s).alias("p0"), F.when(s >= 0.5, 0.9).otherwise(0.0).alias("p1"), s.alias("rh"))
    out = nf.policy_values(w.withColumn("w", nf.importance_weights(F.col("a"), F.col("p0"), F.col("p1"))), "a", "r", "w", "p1", "rh")
    return out.select(*[F.round(c, 6).alias(c) for c in ("ips", "snips", "dm", "dr")], F.round("ess", 3).alias("ess"))


@query(f"WITH {LI} SELECT round(avg((score < 0.6::DOUBLE)::INT) FILTER (score >= 0.5), 6) AS violation FROM li")
def ope_support(t: Tables) -> DataFrame:
    d = li(t).select(F.when(F.col("score") >= 0.6, 0.5).otherwise(0.0).alias("p0"), F.when(F.col("score") >= 0.5, 0.9).otherwise(0.0).alias("p1"))
    return r6(nf.support_violation(d, "p0", "p1"))


@query(f"""WITH {EV}, o AS (SELECT row_number() OVER (ORDER BY abs(score - 0.3), event_id) AS k, ((score >= 0.3)::INT <> y)::INT AS e FROM ev), r AS (SELECT k, sum(e) OVER (ORDER BY k) AS e FROM o), c AS (SELECT unnest([0.1, 0.5, 1.0])::DOUBLE AS coverage),
w AS (SELECT coverage, greatest(round_even(coverage * (SELECT count(*) FROM ev), 0), 1)::BIGINT AS rows FROM c) SELECT coverage, rows, round(e / rows::DOUBLE, 6) AS risk FROM w JOIN r ON k = rows""")
def risk_coverage(t: Tables) -> DataFrame:
    e = ev(t).withColumns({"u": F.abs(F.col("score") - 0.3), "e": ((F.col("score") >= 0.3).cast("int") != F.col("y")).cast("int")})
    return r6(nf.risk_coverage(e, "u", "e", "event_id", [0.1, 0.5, 1.0]), "risk")


@query(f"""WITH {LI}, g AS (SELECT unnest(range(1, 20)) / 20::DOUBLE AS threshold), r AS (SELECT threshold, avg((y = 1 AND score < threshold)::INT) AS risk, (SELECT count(*) FROM li) AS n FROM li, g GROUP BY threshold)
SELECT coalesce(max(CASE WHEN (n * risk + 1) / (n + 1) <= 0.1::DOUBLE THEN threshold END), min(threshold)) AS threshold FROM r""")
def crc_threshold(t: Tables) -> DataFrame:
    grid = t.spark.range(1, 20).select((F.col("id") / 20.0).alias("threshold"))
    risks = li(t).crossJoin(F.broadcast(grid)).groupBy("threshold").agg(F.avg(((F.col("y") == 1) & (F.col("score") < F.col("threshold"))).cast("double")).alias("risk"), F.count(F.lit(1)).alias("n"))
    ok = (F.col("n") * F.col("risk") + 1.0) / (F.col("n") + 1) <= 0.1
    return risks.agg(F.coalesce(F.max(F.when(ok, F.col("threshold"))), F.min("threshold")).alias("threshold"))


@query(f"""WITH {LI}, b AS (SELECT score, row_number() OVER (ORDER BY score DESC) - 1 AS above, count(*) OVER () AS n FROM li WHERE y = 0 AND score IS NOT NULL),
p AS (SELECT k, n, exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.05::DOUBLE) + (n - k) * ln(0.95::DOUBLE)) AS p FROM (SELECT unnest(range(n // 10 + 10)) AS k, n FROM (SELECT any_value(n) AS n FROM b)) WHERE k <= n),
m AS (SELECT max(k) AS m FROM (SELECT k, sum(p) OVER (ORDER BY k) AS cdf FROM p) WHERE cdf <= 0.1)
SELECT coalesce((SELECT round(score, 6) FROM b, m WHERE above = m), 'inf'::DOUBLE) AS threshold""")
def neyman_pearson(t: Tables) -> DataFrame:
    benign = li(t).where("y = 0 and score is not null")
    return r6(nf.threshold_from_count(benign, "score", nf.np_admissible_count(benign.count(), 0.05, 0.1)))


@query(f"WITH {EV}, u AS (SELECT unnest([50, 100, 150])::DOUBLE AS threshold) SELECT threshold, round(avg(value - threshold), 6) AS mean_excess, count(*) AS n FROM ev, u WHERE value > threshold GROUP BY threshold")
def mean_excess(t: Tables) -> DataFrame:
    u = t.spark.createDataFrame([(50.0,), (100.0,), (150.0,)], "threshold double")
    return r6(nf.mean_excess(ev(t), "value", u), "mean_excess")


CS = f"""WITH {EV}, s AS (SELECT label, event_id, row_number() OVER w AS n, avg((score - 0.15) * 0.7310585786300049::DOUBLE) OVER w AS mean FROM ev WINDOW w AS (PARTITION BY label ORDER BY ts, event_id)),
c AS (SELECT *, 0.2::DOUBLE * sqrt((n + 10::DOUBLE) * ln((n + 10::DOUBLE) / (10::DOUBLE * 0.05::DOUBLE * 0.05::DOUBLE))) / n AS half FROM s)"""


def _cs(t: Tables) -> DataFrame:
    e = ev(t).withColumn("d", (F.col("score") - 0.15) * 0.7310585786300049)
    return nf.confidence_sequence(e, ["label"], ["ts", "event_id"], "d", 10.0, 0.05, 0.2)


@query(CS + " SELECT event_id, n, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high FROM c")
def confidence_sequence(t: Tables) -> DataFrame:
    return r6(_cs(t).select("event_id", "n", "mean", "low", "high"))


@query(CS + " SELECT label, coalesce(min(CASE WHEN mean - half > 0 OR mean + half < 0 THEN n END), 0)::BIGINT AS first FROM c GROUP BY label")
def first_conclusive(t: Tables) -> DataFrame:
    return nf.first_conclusive(_cs(t), ["label"])


UP, LOW = sc.wald_boundaries(0.01, 0.10)


@query(f"""WITH {EV}, s AS (SELECT user_id, row_number() OVER w AS n, sum(CASE WHEN value >= 80 THEN {math.log(0.4 / 0.1)!r}::DOUBLE ELSE {math.log(0.6 / 0.9)!r}::DOUBLE END) OVER w AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT user_id, min(n) FILTER (s >= {UP!r} OR s <= {LOW!r}) AS f, count(*) AS steps FROM s GROUP BY user_id)
SELECT f.user_id, CASE WHEN f IS NULL THEN 'open' WHEN s >= {UP!r} THEN 'attack' ELSE 'benign' END AS decision, coalesce(f, steps) AS steps FROM f LEFT JOIN s ON s.user_id = f.user_id AND s.n = f.f""")
def sprt(t: Tables) -> DataFrame:
    return nf.sprt(ev(t), ["user_id"], ["ts", "event_id"], sc.llr(F.col("value") >= 80, 0.4, 0.1), UP, LOW)


@query(f"WITH {EV} SELECT event_id, round(avg(y) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 6) AS rate FROM ev")
def rolling_rate(t: Tables) -> DataFrame:
    return r6(nf.rolling_rate(ev(t), ["user_id"], ["ts", "event_id"], "y", 10).select("event_id", "rate"))


@query(f"""WITH {EV}, b AS (SELECT *, (value >= 120)::INT AS bad FROM ev), r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, avg(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING) AS lg, avg(bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING) AS sh FROM b)
SELECT user_id, min(CASE WHEN n >= 20 AND lg >= {3.0 * 0.05!r}::DOUBLE AND sh >= {3.0 * 0.05!r}::DOUBLE THEN n END)::INTEGER AS first_firing FROM r GROUP BY user_id""")
def burn_first_firing(t: Tables) -> DataFrame:
    return nf.first_firing(ev(t).withColumn("bad", (F.col("value") >= 120).cast("int")), ["user_id"], ["ts", "event_id"], "bad", 0.05, 20, 5, 3.0)


@query(f"""WITH {EV}, p AS (SELECT event_id, label, ts, (event_id * 2654435761 % 4294967296 + 1) / 4294967297::DOUBLE AS p FROM ev), s AS (SELECT event_id, {', '.join(f"sum({math.log(e)!r}::DOUBLE + ({e} - 1) * ln(greatest(p, 1e-12::DOUBLE))) OVER w AS l{i}" for i, e in enumerate((0.25, 0.5, 0.75)))} FROM p WINDOW w AS (PARTITION BY label ORDER BY ts, event_id)),
m AS (SELECT *, greatest(l0, l1, l2) AS t FROM s) SELECT event_id, round(t + ln((exp(l0 - t) + exp(l1 - t) + exp(l2 - t)) / 3), 5) AS log_m FROM m""")
def power_martingale(t: Tables) -> DataFrame:
    p = ev(t).withColumn("p", (mix32(F.col("event_id")) + 1) / float((1 << 32) + 1))
    return nf.power_martingale(p, ["label"], ["ts", "event_id"], "p", (0.25, 0.5, 0.75)).select("event_id", F.round("log_m", 5).alias("log_m"))


# --- drift --------------------------------------------------------------------------------------

FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LONG = "l AS (SELECT year(l_shipdate) < 1998 AS ref, unnest([{'f': 'l_quantity', 'v': l_quantity}, {'f': 'l_extendedprice', 'v': l_extendedprice * CASE WHEN year(l_shipdate) < 1998 THEN 1 ELSE 1.2 END}, {'f': 'l_discount', 'v': l_discount}, {'f': 'l_tax', 'v': l_tax}], recursive := true) FROM lineitem)"


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    y = F.year("l_shipdate")
    return t.lineitem.where(y < 1998), t.lineitem.where(y >= 1998).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.2)


@query(f"""WITH {LONG}, e AS (SELECT f, list_sort(list_distinct(quantile_cont(v, [x / 10::DOUBLE for x in range(1, 10)]))) AS edges FROM l WHERE ref GROUP BY f), b AS (SELECT l.f, ref, len(list_filter(edges, lambda x: x <= v)) AS bin, len(edges) AS k FROM l JOIN e USING (f)),
s AS (SELECT f, ref, bin, count(*) / sum(count(*)) OVER (PARTITION BY f, ref)::DOUBLE AS s FROM b GROUP BY f, ref, bin), g AS (SELECT f, unnest(range(len(edges) + 1)) AS bin FROM e),
p AS (SELECT g.f, greatest(coalesce(r.s, 0), 1e-6::DOUBLE) AS r, greatest(coalesce(c.s, 0), 1e-6::DOUBLE) AS c FROM g LEFT JOIN (SELECT * FROM s WHERE ref) r USING (f, bin) LEFT JOIN (SELECT * FROM s WHERE NOT ref) c USING (f, bin)), o AS (SELECT f, sum((c - r) * ln(c / r)) AS psi FROM p GROUP BY f)
SELECT f AS feature, round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'major' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS drift FROM o""")
def psi_features(t: Tables) -> DataFrame:
    return r6(dr.psi(*_halves(t), FEATURES))


@query(f"""WITH {LONG}, a AS (SELECT f, v, count(*) FILTER (ref) AS ra, count(*) FILTER (NOT ref) AS cb FROM l GROUP BY f, v), r AS (SELECT *, sum(ra) OVER w AS ca, sum(cb) OVER w AS cc, sum(ra) OVER p AS n, sum(cb) OVER p AS m FROM a WINDOW w AS (PARTITION BY f ORDER BY v), p AS (PARTITION BY f))
SELECT f AS feature, round(max(abs(ca / n::DOUBLE - cc / m::DOUBLE)), 6) AS ks, max(n)::BIGINT AS n, max(m)::BIGINT AS m FROM r GROUP BY f""")
def ks_features(t: Tables) -> DataFrame:
    return r6(dr.ks(*_halves(t), FEATURES), "ks")


@query(f"""WITH {EV}, a AS (SELECT label, row_number() OVER w AS n, value - avg(value) OVER w - 0.005::DOUBLE AS d, ts, event_id FROM ev WINDOW w AS (PARTITION BY label ORDER BY ts, event_id)), m AS (SELECT *, sum(d) OVER (PARTITION BY label ORDER BY n) AS m FROM a),
l AS (SELECT *, least(0, min(m) OVER (PARTITION BY label ORDER BY n)) AS lo FROM m) SELECT label, min(CASE WHEN m - lo > 500 THEN n END)::INTEGER AS alarm FROM l GROUP BY label""")
def page_hinkley(t: Tables) -> DataFrame:
    return dr.page_hinkley(ev(t), ["label"], ["ts", "event_id"], F.col("value"), 0.005, 500.0)


@query(f"""WITH {EV}, a AS (SELECT label, row_number() OVER w AS n, avg((value >= 100)::INT) OVER w AS p FROM ev WINDOW w AS (PARTITION BY label ORDER BY ts, event_id)), s AS (SELECT *, sqrt(p * (1 - p) / n) AS s, n >= 30 AND p > 0 AS armed FROM a),
b AS (SELECT *, min(CASE WHEN armed THEN {{'l': p + s, 'n': n, 'p': p, 's': s}} END) OVER (PARTITION BY label ORDER BY n) AS best FROM s), f AS (SELECT label, min(CASE WHEN armed AND p + s > best.p + 3 * best.s THEN n END)::INTEGER AS drift, min(CASE WHEN armed AND p + s > best.p + 2 * best.s THEN n END)::INTEGER AS warning FROM b GROUP BY label)
SELECT label, drift, CASE WHEN drift IS NULL OR warning < drift THEN warning END AS warning FROM f""")
def ddm(t: Tables) -> DataFrame:
    return dr.ddm(ev(t), ["label"], ["ts", "event_id"], F.col("value") >= 100)


@query(f"""WITH {EV}, v AS (SELECT day, count(*) FILTER (value >= 100) AS volume FROM ev GROUP BY day), r AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i, row_number() OVER (ORDER BY day DESC) AS j, abs(volume - lag(volume) OVER (ORDER BY day)) AS st FROM v)
SELECT round(greatest(0, (max(volume) - 50) / 50::DOUBLE), 6) AS overshoot, (coalesce(max(CASE WHEN abs(volume - 50) > 10 THEN i END), -1) + 1)::INTEGER AS settled_at, round((avg(volume) FILTER (j <= 10) - 50) / 50, 6) AS steady_error, round(avg(st), 6) AS oscillation FROM r""")
def control_summary(t: Tables) -> DataFrame:
    volumes = dr.batch_volumes(ev(t), "day", F.col("value") >= 100)
    return r6(dr.control_summary(volumes, "day", 50.0, 0.2, 10))


@query(f"""WITH {EV}, p AS (SELECT y, value / 100 AS v, row_number() OVER (PARTITION BY y ORDER BY event_id * 2654435761 % 4294967296, event_id) - 1 AS i FROM ev), q AS (SELECT y, i // 2 AS k, max(CASE WHEN i % 2 = 0 THEN v END) AS a, max(CASE WHEN i % 2 = 1 THEN v END) AS b FROM p GROUP BY ALL HAVING count(*) = 2),
h AS (SELECT exp(-((x.a - x.b) ^ 2)) + exp(-((z.a - z.b) ^ 2)) - exp(-((x.a - z.b) ^ 2)) - exp(-((x.b - z.a) ^ 2)) AS h FROM q x JOIN q z ON x.k = z.k AND x.y = 1 AND z.y = 0) SELECT round(avg(h), 6) AS mmd2, round(avg(h) / (stddev_samp(h) / sqrt(count(*))), 6) AS z, count(*) AS pairs FROM h""")
def linear_mmd(t: Tables) -> DataFrame:
    e = ev(t).withColumn("v", F.col("value") / 100)
    return r6(dr.linear_time_mmd(e.where("y = 1"), e.where("y = 0"), "event_id", "v", 1.0))


@query(f"WITH {EV} SELECT label, round(avg(value), 6) AS mean_weight, round(sum(value) ^ 2 / sum(value ^ 2), 4) AS ess FROM ev GROUP BY label")
def covariate_weights(t: Tables) -> DataFrame:
    return dr.covariate_weights(ev(t), "value", "label").select("label", F.round("mean_weight", 6).alias("mean_weight"), F.round("ess", 4).alias("ess"))
