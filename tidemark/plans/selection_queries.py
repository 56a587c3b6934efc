"""Queries of row selection, operating points, serving checks and attack measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import selection as sl
from tidemark.plans.ranking_queries import EV, LI, ev, li, r6
from tidemark.plans.registry import Tables, query


def _u(key: str, salt: int | str = 0) -> str:
    """SQL of ``selection.hash_draw``."""
    return f"((({key} + {salt} * 7919) % 2147483648) * 2654435761 % 4294967296) / 4294967296::DOUBLE"


@query(f"WITH {EV} SELECT event_id, round(score, 6) AS score FROM ev ORDER BY abs(score - 0.5), event_id LIMIT 100")
def select_uncertain(t: Tables) -> DataFrame:
    return r6(sl.select_uncertain(ev(t), "score", "event_id", 100).select("event_id", "score"))


@query(f"SELECT event_id FROM events ORDER BY {_u('event_id', 3)}, event_id LIMIT 100")
def select_random(t: Tables) -> DataFrame:
    return sl.select_random(t.events, "event_id", 100, 3).select("event_id")


@query(f"""WITH {EV}, c AS (SELECT sum(y) AS pos, sum(1 - y) AS neg, round(sum(1 - y) * 0.1 / 0.9) AS wanted FROM ev),
p AS (SELECT event_id, y, row_number() OVER (PARTITION BY y ORDER BY {_u('event_id', 1)}, event_id) AS p FROM ev)
SELECT y, count(*) AS n, sum(event_id)::BIGINT AS ids FROM p, c
WHERE p <= CASE WHEN wanted <= pos THEN CASE WHEN y = 1 THEN greatest(wanted, 1) ELSE neg END ELSE CASE WHEN y = 1 THEN pos ELSE least(neg, round(pos * 0.9 / 0.1)) END END GROUP BY y""")
def resample_to_prevalence(t: Tables) -> DataFrame:
    out = sl.resample_to_prevalence(ev(t), "y", "event_id", 0.1, 1)
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query(f"WITH {EV} SELECT event_id, row_number() OVER (ORDER BY CASE day % 4 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 0 THEN 2 ELSE 3 END, event_id) AS stream_pos FROM ev")
def order_stream(t: Tables) -> DataFrame:
    days = ev(t).withColumn("d", (F.col("day") % 4).cast("string"))
    return sl.order_stream(days, "d", ["3", "1", "0"], "event_id").select("event_id", "stream_pos")


@query(f"""WITH {EV}, d AS (SELECT event_id, (day % 7)::VARCHAR AS d, CASE WHEN day % 7 IN (0, 3) THEN 0 ELSE y END AS a FROM ev WHERE day % 7 < 6),
p AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY event_id) AS p FROM d), q AS (SELECT * FROM p WHERE p <= 300),
c AS (SELECT d, count(*) AS n, max(a) AS attacked FROM q GROUP BY d), k AS (SELECT d, CASE WHEN attacked = 1 THEN floor(n * 0.6::DOUBLE) ELSE n END AS cut, (SELECT min(x.d) FROM c x WHERE x.attacked = 1 AND x.d >= c.d) AS task FROM c)
SELECT task, CASE WHEN p <= cut THEN 'train' ELSE 'held' END AS part, count(*) AS n, sum(event_id)::BIGINT AS ids FROM q JOIN k USING (d) WHERE task IS NOT NULL GROUP BY ALL""")
def day_tasks(t: Tables) -> DataFrame:
    d = F.col("day") % 7
    rows = ev(t).select("event_id", d.cast("string").alias("d"), F.when(d.isin(0, 3), 0).otherwise(F.col("y")).alias("a"))
    out = sl.day_tasks(rows, "d", list("012345"), "event_id", "a", 300, 0.6)
    return out.groupBy("task", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH v AS (SELECT 'p_size' AS feature, p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part),
s AS (SELECT feature, list_sort(list(v)) AS s, count(*) AS n FROM v GROUP BY feature),
e AS (SELECT feature, list_sort(list_distinct([s[floor(k / 4::DOUBLE * (n - 1))::BIGINT + 1] for k in range(5)])) AS e FROM s),
i AS (SELECT feature, e, unnest(range(len(e) - 1)) AS k FROM e WHERE len(e) >= 3)
SELECT feature, CASE WHEN k = 0 THEN '-inf'::DOUBLE ELSE e[k + 1] END AS low, CASE WHEN k = len(e) - 2 THEN 'inf'::DOUBLE ELSE e[k + 2] END AS high FROM i""")
def quantile_literals(t: Tables) -> DataFrame:
    return sl.quantile_literals(t.part, ["p_size", "p_retailprice"], 4)


@query(f"WITH {LI} SELECT round(quantile_cont(score, 0.1) FILTER (l_partkey % 11 < 3), 6) AS threshold FROM li")
def stage1_threshold(t: Tables) -> DataFrame:
    return r6(sl.stage1_threshold(li(t).withColumn("alerted", F.col("l_partkey") % 11 < 3), "score", "alerted", 0.9))


@query(f"""WITH {LI}, r AS (SELECT (rank() OVER (ORDER BY score) - 1) / (count(*) OVER ())::DOUBLE AS below, (l_partkey % 97 / 97::DOUBLE >= 0.6 AND y = 1) AS hit FROM li)
SELECT keep, round(count(*) FILTER (hit AND below >= 1 - keep) / count(*) FILTER (hit)::DOUBLE, 6) AS retained, count(*) FILTER (hit) AS detected FROM r, (SELECT unnest([0.1, 0.25, 0.5])::DOUBLE AS keep) GROUP BY keep""")
def detection_retention(t: Tables) -> DataFrame:
    full = li(t).withColumn("full", F.col("l_partkey") % 97 / 97.0)
    return r6(sl.detection_retention(full, "score", "full", "y", 0.6, [0.1, 0.25, 0.5]), "retained")


@query(f"WITH {EV} SELECT threshold, round(avg((score >= threshold)::INT), 6) AS rate FROM ev, (SELECT unnest([0.05, 0.1, 0.3])::DOUBLE AS threshold) GROUP BY threshold")
def realised_rates(t: Tables) -> DataFrame:
    return r6(sl.realised_rates(ev(t), "score", [0.05, 0.1, 0.3]), "rate")


@query(f"WITH {EV}, f AS (SELECT user_id, avg((score >= 0.2)::INT) AS fpr FROM ev WHERE y = 0 GROUP BY user_id) SELECT round(avg((fpr BETWEEN 0.2 / 1.5::DOUBLE AND 0.2 * 1.5::DOUBLE)::INT), 6) AS share FROM f")
def compliance_share(t: Tables) -> DataFrame:
    per = ev(t).where("y = 0").groupBy("user_id").agg(F.avg((F.col("score") >= 0.2).cast("double")).alias("fpr"))
    return r6(sl.compliance_share(per, "fpr", 0.2, 1.5))


@query(f"""WITH {EV}, s AS (SELECT t.trial, y, score, row_number() OVER (PARTITION BY t.trial ORDER BY {_u('event_id', 't.trial')}, event_id) AS p FROM ev, (SELECT unnest(range(5)) AS trial) t),
g AS (SELECT trial, score, sum(1 - y) AS neg FROM s WHERE p <= 400 GROUP BY ALL), r AS (SELECT *, sum(neg) OVER (PARTITION BY trial ORDER BY score DESC) AS fp, sum(neg) OVER (PARTITION BY trial) AS n FROM g),
c AS (SELECT trial, coalesce(min(score) FILTER (fp <= 0.05::DOUBLE * n), 'inf'::DOUBLE) AS threshold FROM r GROUP BY trial)
SELECT trial::INTEGER AS trial, round(threshold, 6) AS threshold, round(sum((score >= threshold AND y = 0)::INT) / sum(1 - y)::DOUBLE, 6) AS fpr, round(sum((score >= threshold AND y = 1)::INT) / sum(y)::DOUBLE, 6) AS tpr FROM ev, c GROUP BY trial, threshold""")
def label_budget_trials(t: Tables) -> DataFrame:
    return r6(sl.label_budget_trials(ev(t), "event_id", "y", "score", 400, 0.05, 5))


@query(f"WITH {EV} SELECT unnest([0.1, 0.4, 0.75])::DOUBLE AS share, round(unnest([quantile_cont(value, 0.5 / 0.9::DOUBLE), quantile_cont(value, 0.5 / 0.6::DOUBLE), quantile_cont(value, 0.25 / 0.75::DOUBLE) + 600]), 6) AS median_wait FROM ev")
def wait_sensitivity(t: Tables) -> DataFrame:
    return r6(sl.wait_sensitivity(ev(t), "value", 600.0, [0.1, 0.4, 0.75]), "median_wait")


@query(f"""WITH {EV}, f AS (SELECT value, (event_id % 20 = 0)::INT AS f, row_number() OVER (ORDER BY value, event_id) AS p, rank() OVER (ORDER BY -value) + (count(*) OVER (PARTITION BY value) - 1) / 2::DOUBLE AS r FROM ev), n AS (SELECT sum(f) AS k, count(*) AS n FROM f)
SELECT k::BIGINT AS n_flips, (sum(f) FILTER (p <= k))::BIGINT AS hits, round((sum(r) FILTER (f = 1) - k * (k + 1) / 2::DOUBLE) / (k * (n - k)), 6) AS auc, round((sum(f) FILTER (p <= k)) / k::DOUBLE, 6) AS precision FROM f, n GROUP BY k, n""")
def flip_recovery(t: Tables) -> DataFrame:
    return r6(sl.flip_recovery(ev(t).withColumn("f", F.col("event_id") % 20 == 0), "value", "f", "event_id"))


@query(f"""WITH {EV}, s AS (SELECT event_id, y, greatest(0, least(1, 0.7 + 0.5 * (score - 0.5))) AS skill FROM ev)
SELECT y, round(avg(skill), 6) AS skill, round(avg(CASE WHEN {_u('event_id', 2)} < skill THEN y ELSE 1 - y END), 6) AS verdict FROM s GROUP BY y""")
def analyst_verdicts(t: Tables) -> DataFrame:
    skilled = ev(t).withColumn("skill", sl.analyst_skill("correlated", F.col("score"), F.lit(0.5), 0.7, 0.5))
    return r6(skilled.groupBy("y").agg(F.avg("skill").alias("skill"), F.avg(sl.analyst_verdict(F.col("skill"), F.col("y"), "event_id", 2)).alias("verdict")))


@query(f"WITH {LI} SELECT label, count(*) AS scored, round(avg(abs(score - l_partkey % 97 / 97::DOUBLE)), 6) AS mean_gap, count(*) FILTER ((score >= 0.5) <> (l_partkey % 97 / 97::DOUBLE >= 0.4)) AS disagreements FROM li GROUP BY label")
def shadow_disagreement(t: Tables) -> DataFrame:
    both = li(t).withColumn("shadow", F.col("l_partkey") % 97 / 97.0)
    return r6(sl.shadow_disagreement(both, "score", "shadow", 0.5, 0.4, ["label"]))


@query(f"""WITH {LI}, m AS (SELECT avg(score) AS mean, max(score) AS top FROM li)
SELECT 'mean' AS name, 'least' AS rule, 0.3::DOUBLE AS required, round(mean, 6) AS measured, mean >= 0.3 AS ok FROM m UNION ALL SELECT 'recall', 'least', 0.5, NULL, FALSE FROM m UNION ALL SELECT 'top', 'most', 0.9, round(top, 6), top <= 0.9 FROM m""")
def gate_checks(t: Tables) -> DataFrame:
    m = li(t).agg(F.avg("score").alias("mean"), F.max("score").alias("top"))
    return r6(sl.checks(m, {"mean": 0.3, "recall": 0.5}, {"top": 0.9}), "measured")


@query("""WITH g AS (SELECT p_brand, CASE p_size % 4 WHEN 0 THEN 'met' WHEN 1 THEN 'partial' WHEN 2 THEN 'missing' ELSE 'not_applicable' END AS g FROM part), w AS (SELECT p_brand, CASE g WHEN 'met' THEN 1 WHEN 'partial' THEN 0.5 WHEN 'missing' THEN 0 END AS w FROM g)
SELECT p_brand, round(coalesce(avg(w), 0), 6) AS ratio, count(w) AS applicable FROM w GROUP BY p_brand""")
def control_coverage(t: Tables) -> DataFrame:
    grade = F.get(F.array(*map(F.lit, ("met", "partial", "missing", "not_applicable"))), F.col("p_size") % 4)
    return r6(sl.coverage_ratio(t.part.withColumn("g", grade), "g", ["p_brand"]), "ratio")


@query(f"WITH {EV} SELECT DISTINCT day, label, (('0x' || substr(sha1(day::VARCHAR || '|' || label), 1, 8))::BIGINT % 100000)::DOUBLE AS code FROM ev")
def session_codes(t: Tables) -> DataFrame:
    return ev(t).select("day", "label", sl.session_code(F.col("day").cast("string"), F.col("label")).alias("code")).distinct()


@query(f"""WITH {LI}, k AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM li GROUP BY score), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM k WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos / p::DOUBLE * tp / (tp + fp)), 6) AS average_precision, round(sum(pos * ((n - fp) + neg / 2::DOUBLE)) / max(p * n), 6) AS roc_auc FROM r""")
def quick_metrics(t: Tables) -> DataFrame:
    return r6(sl.quick_metrics(li(t)))


def _ari_sql(a: str, b: str, source: str) -> str:
    return f"""(WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS x, sum(n) AS n FROM c),
ra AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS r FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT (x - ra.r * rb.r / (n * (n - 1) / 2)) / ((ra.r + rb.r) / 2 - ra.r * rb.r / (n * (n - 1) / 2)) AS ari FROM x, ra, rb)"""


@query(f"SELECT round(ari, 6) AS ari FROM {_ari_sql('p_brand', 'p_type', 'part')}")
def adjusted_rand(t: Tables) -> DataFrame:
    return r6(sl.adjusted_rand(t.part, "p_brand", "p_type"))


@query("SELECT round(avg(ari), 6) AS ari FROM (" + " UNION ALL ".join(f"SELECT * FROM {_ari_sql('p_type', 'floor(' + _u('p_partkey', s) + ' * 5)', 'part')}" for s in (1, 2, 3)) + ")")
def random_baseline_ari(t: Tables) -> DataFrame:
    return r6(sl.random_baseline_ari(t.part, "p_type", "p_partkey", 5, 3))


@query("""WITH a AS (SELECT p_brand, [avg(p_size), avg(p_retailprice)] AS v FROM part GROUP BY 1), b AS (SELECT p_type, [avg(p_size), avg(p_retailprice)] AS v FROM part GROUP BY 1),
d AS (SELECT p_brand, p_type, list_distance(a.v::DOUBLE[], b.v::DOUBLE[]) AS d FROM a, b) SELECT p_brand, arg_min(p_type, d) AS nearest, round(min(d), 5) AS distance FROM d GROUP BY p_brand""")
def nearest_centroid(t: Tables) -> DataFrame:
    v = F.array(F.avg("p_size"), F.avg("p_retailprice")).alias("v")
    out = sl.nearest_centroid(t.part.groupBy("p_brand").agg(v), t.part.groupBy("p_type").agg(v), "p_brand", "p_type", "v")
    return out.withColumn("distance", F.round("distance", 5))


SHAP = """v AS (SELECT p_partkey, (p_size - 20) * (p_retailprice + 900) / 2::DOUBLE / 1000 AS a, (p_retailprice - 900) * (p_size + 20) / 2::DOUBLE / 1000 AS b, (p_partkey - 50) * 0.01::DOUBLE AS c FROM part)"""


def _shap(t: Tables) -> DataFrame:
    """Of a model with an interaction: size * price / 1000 + key / 100."""
    names = {"p_size": 20.0, "p_retailprice": 900.0, "p_partkey": 50.0}
    model = lambda x: x["p_size"] * x["p_retailprice"] / 1000.0 + x["p_partkey"] * 0.01
    return sl.top_attributions(sl.shapley_values(t.part, list(names), names, model), list(names), 2)


@query(f"WITH {SHAP} SELECT p_partkey, round(a, 7) AS shap_p_size, round(b, 7) AS shap_p_retailprice, round(c, 7) AS shap_key FROM v")
def shapley_values(t: Tables) -> DataFrame:
    return _shap(t).select("p_partkey", *[F.round(f"shap_{c}", 7).alias(f"shap_{n}") for c, n in (("p_size", "p_size"), ("p_retailprice", "p_retailprice"), ("p_partkey", "key"))])


@query("""WITH p AS (SELECT p_partkey AS i, p_size::DOUBLE AS a, p_retailprice AS b, p_size >= 25 AS s FROM part), k AS (SELECT *, ((i * 2 + s::INT) % 2147483648) * 2654435761 % 4294967296 AS u FROM p), f AS (SELECT a, b, row_number() OVER (ORDER BY u, s, i) AS r FROM k)
SELECT round(1 / median((x.a - y.a) ^ 2 + (x.b - y.b) ^ 2), 10) AS gamma FROM f x, f y WHERE x.r < y.r AND x.r <= 150 AND y.r <= 150""")
def median_bandwidth(t: Tables) -> DataFrame:
    out = sl.median_bandwidth(t.part.where("p_size < 25"), t.part.where("p_size >= 25"), ["p_size", "p_retailprice"], "p_partkey", 150)
    return out.withColumn("gamma", F.round("gamma", 10))


@query("SELECT round((abs(corr(l_quantity, l_extendedprice)) + abs(corr(l_quantity, l_discount)) + abs(corr(l_extendedprice, l_discount))) / 3, 6) AS mean, round(greatest(abs(corr(l_quantity, l_extendedprice)), abs(corr(l_quantity, l_discount)), abs(corr(l_extendedprice, l_discount))), 6) AS largest FROM lineitem")
def dependence_strength(t: Tables) -> DataFrame:
    return r6(sl.dependence_strength(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT p_partkey, round(p_retailprice + 1.5 * (SELECT stddev_pop(p_retailprice) FROM part), 4) AS price FROM part")
def marginal_shift(t: Tables) -> DataFrame:
    return sl.marginal_shift(t.part, ["p_retailprice"], 1.5).select("p_partkey", F.round("p_retailprice", 4).alias("price"))


@query(f"""WITH p AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) AS r, count(*) OVER () AS n FROM part), a AS (SELECT *, CASE WHEN {_u('p_partkey', 4)} < 0.3 THEN floor({_u('p_partkey', 5)} * n) + 1 END AS d FROM p)
SELECT a.p_partkey, coalesce(b.p_size, a.p_size) AS p_size, a.d IS NOT NULL AS corrupted FROM a LEFT JOIN p b ON a.d = b.r""")
def corrupt(t: Tables) -> DataFrame:
    return sl.corrupt(t.part, ["p_size"], "p_partkey", 0.3, 4).select("p_partkey", "p_size", F.col("p_size_corrupted").alias("corrupted"))


TASKS = f"{EV}, s AS (SELECT user_id % 5 AS learned, day % 5 AS task, avg(value) AS score, 40::DOUBLE AS base FROM ev GROUP BY 1, 2)"


def _transfer(t: Tables) -> DataFrame:
    return ev(t).groupBy((F.col("user_id") % 5).alias("learned"), (F.col("day") % 5).alias("task")).agg(F.avg("value").alias("score"), F.lit(40.0).alias("base"))


@query(f"WITH {TASKS}, m AS (SELECT max(learned) AS m FROM s) SELECT round(avg(e.score - o.score), 6) AS backward FROM s e, s o, m WHERE e.learned = m AND o.learned = o.task AND e.task = o.task AND e.task < m")
def backward_transfer(t: Tables) -> DataFrame:
    return r6(sl.backward_transfer(_transfer(t), "learned", "task", "score"))


@query(f"WITH {TASKS} SELECT round(avg(score - base), 6) AS forward FROM s WHERE learned = task - 1")
def forward_transfer(t: Tables) -> DataFrame:
    return r6(sl.forward_transfer(_transfer(t), "learned", "task", "score", "base"))


@query(f"WITH {EV} SELECT user_id FROM ev GROUP BY user_id HAVING min(y) <> max(y)")
def informative_environments(t: Tables) -> DataFrame:
    return sl.informative_environments(ev(t), "user_id", "y")


@query("""WITH s AS (SELECT p_size % 5 > 0 AS agree, p_size / 50::DOUBLE AS strength, p_retailprice / 1000 AS dispersion FROM part)
SELECT CASE WHEN NOT agree THEN 'flipped sign' WHEN strength < 0.3 THEN 'too weak' WHEN dispersion > 1.5 THEN 'unstable magnitude' ELSE 'passed' END AS outcome, count(*) AS features FROM s GROUP BY 1""")
def screen_breakdown(t: Tables) -> DataFrame:
    s = t.part.select((F.col("p_size") % 5 > 0).alias("agree"), (F.col("p_size") / 50.0).alias("strength"), (F.col("p_retailprice") / 1000).alias("dispersion"))
    return sl.screen_breakdown(s, "agree", "strength", "dispersion", 0.3, 1.5)


@query(f"WITH {LI} SELECT round(avg((score * 0.6 < 0.4)::INT), 6) AS success FROM li WHERE score >= 0.4 AND y = 1")
def attack_success_rate(t: Tables) -> DataFrame:
    padded = sl.pad_features(li(t).withColumns({"triggered": F.col("score"), "caught": (F.col("score") >= 0.4) & (F.col("y") == 1)}), ["triggered"], 0.6)
    return r6(sl.attack_success_rate(padded, "triggered", 0.4, "caught"))


@query(f"""WITH {EV}, p AS (SELECT event_id, label, [score, (1 - score) * 0.7::DOUBLE, (1 - score) * 0.3::DOUBLE] AS p, ['error', 'click', 'view'] AS c FROM ev)
SELECT event_id, round(list_reverse_sort(p)[1], 6) AS top1, round(list_reverse_sort(p)[2], 6) AS top2, round(coalesce(p[list_position(c, label)], 0), 6) AS true_probability,
(c[list_position(p, list_max(p))] = label)::INT::DOUBLE AS correct, round(-list_sum([x * ln(greatest(x, 1e-12)) for x in p]), 6) AS entropy FROM p""")
def confidence_features(t: Tables) -> DataFrame:
    s = F.col("score")
    p = ev(t).withColumn("p", F.array(s, (1 - s) * 0.7, (1 - s) * 0.3))
    return r6(p.select("event_id", *[c.alias(n) for n, c in sl.confidence_features("p", ["error", "click", "view"], "label", 2).items()]))


@query(f"""WITH {LI}, k AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM li GROUP BY score), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM k WINDOW w AS (ORDER BY score DESC))
SELECT round(sum(pos * ((n - fp) + neg / 2::DOUBLE)) / max(p * n), 6) AS auc, round(greatest(0, max(tp / p::DOUBLE - fp / n::DOUBLE)), 6) AS advantage, round(coalesce(max(tp / p::DOUBLE) FILTER (fp / n::DOUBLE <= 0.1), 0), 6) AS tpr_at_budget FROM r""")
def membership_summary(t: Tables) -> DataFrame:
    return r6(sl.membership_summary(li(t), "y", "score", 0.1))


@query(f"""WITH {EV}, p AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 100 AS batch, score, y FROM ev), own AS (SELECT batch, score, y, FALSE AS decoy, batch BETWEEN 2 AND 4 AND y = 1 AS protected FROM p),
loud AS (SELECT score, row_number() OVER (ORDER BY event_id) AS i, count(*) OVER () AS n FROM ev WHERE score >= (SELECT quantile_cont(score, 0.9) FROM ev)),
s AS (SELECT batch, (((batch * 20 + d + 7) % 2147483648) * 2654435761 % 4294967296) % n + 1 AS i FROM (SELECT DISTINCT batch FROM p WHERE batch BETWEEN 2 AND 4), (SELECT unnest(range(20)) AS d), (SELECT any_value(n) AS n FROM loud)),
a AS (SELECT * FROM own UNION ALL SELECT batch, score, 1, TRUE, FALSE FROM s JOIN loud USING (i)) SELECT batch, decoy, protected, count(*) AS n, round(sum(score), 4) AS score FROM a GROUP BY ALL""")
def flood(t: Tables) -> DataFrame:
    out = sl.flood(ev(t), "event_id", "score", "y", 100, 2, 3, 20, 0.9, 7)
    return out.groupBy("batch", "decoy", "protected").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


@query(f"""WITH b AS (SELECT p_partkey, p_size % 5 AS level, [0, 1, 2.5, 4, 6]::DOUBLE[] AS e FROM part), d AS (SELECT *, greatest(0, least(3, level - 1)) AS k, {_u('p_partkey', 6)} AS u FROM b)
SELECT p_partkey, CASE WHEN level > 0 THEN round(exp(e[k + 1] + u * (e[k + 2] - e[k + 1])) - 1, 6) END AS value FROM d""")
def sample_within_bins(t: Tables) -> DataFrame:
    value = sl.sample_within_bins(F.col("p_size") % 5, [0, 1, 2.5, 4, 6], "p_partkey", 6)
    return r6(t.part.select("p_partkey", value.alias("value")))


@query(f"WITH {EV} SELECT round(sum(1 + score + value / 1000 + score * score), 4) AS context, count(*) FILTER (score >= 0.3) AS by_threshold, count(*) FILTER ({_u('event_id', 8)} < 0.2) AS by_chance FROM ev")
def policy_actions(t: Tables) -> DataFrame:
    context = F.aggregate(sl.bandit_context(F.col("score"), F.col("value") / 1000), F.lit(0.0), lambda s, x: s + x)
    return ev(t).agg(F.round(F.sum(context), 4).alias("context"), F.count_if(sl.threshold_policy(F.col("score"), 0.3)).alias("by_threshold"), F.count_if(sl.random_policy("event_id", 0.2, 8)).alias("by_chance"))
