"""Queries of the attribution and robustness operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import explain as xp
from tidemark.plans.ranking_queries import EV, ev, r6
from tidemark.plans.registry import Tables, query

NAMES = ("p_size", "p_retailprice")
CENTRE = {"p_size": 10.0, "p_retailprice": 950.0}


def model(x):  # noqa: ANN001, ANN201
    return 1 / (1 + F.exp(-(0.08 * x["p_size"] + 0.004 * x["p_retailprice"] - 6 + 0.0001 * x["p_size"] * x["p_retailprice"])))


def _m(a: str, b: str) -> str:
    return f"(1 / (1 + exp(-(0.08 * {a} + 0.004 * {b} - 6 + 0.0001 * {a} * {b}))))"


BASE = _m("p_size", "p_retailprice")


@query(f"SELECT p_partkey, 'p_size' AS feature, round({BASE} - {_m('10', 'p_retailprice')}, 6) AS contribution FROM part UNION ALL SELECT p_partkey, 'p_retailprice', round({BASE} - {_m('p_size', '950')}, 6) FROM part")
def occlusion(t: Tables) -> DataFrame:
    return r6(xp.occlusion(t.part, "p_partkey", NAMES, CENTRE, model))


@query(f"""WITH s AS (SELECT p_partkey, {BASE} AS b, {_m('10', 'p_retailprice')} AS s1, {_m('p_size', '950')} AS s2, {_m('10', '950')} AS s12 FROM part),
f AS (SELECT *, CASE WHEN b >= 0.5 AND least(s1, s2) < b THEN CASE WHEN s1 <= s2 THEN 1 ELSE 2 END ELSE 0 END AS one FROM s), g AS (SELECT *, CASE one WHEN 0 THEN b WHEN 1 THEN s1 ELSE s2 END AS n FROM f),
h AS (SELECT *, one > 0 AND n >= 0.5 AND s12 < n AS two FROM g) SELECT p_partkey, CASE one WHEN 0 THEN '' WHEN 1 THEN 'p_size' ELSE 'p_retailprice' END || CASE WHEN two THEN CASE one WHEN 1 THEN '>p_retailprice' ELSE '>p_size' END ELSE '' END AS moved, round(CASE WHEN two THEN s12 ELSE n END, 6) AS final_score, CASE WHEN two THEN s12 ELSE n END < 0.5 AS escaped FROM h""")
def recourse(t: Tables) -> DataFrame:
    out = xp.recourse(t.part, NAMES, NAMES, CENTRE, model, 0.5, 2)
    return r6(out.select("p_partkey", F.concat_ws(">", "moved").alias("moved"), "final_score", "escaped"))


@query(f"SELECT e AS effort, round(avg(({_m('(p_size + e * (10 - p_size))', 'p_retailprice')} >= 0.5)::INT), 6) AS detection FROM part, (SELECT unnest([0, 0.25, 0.5, 1])::DOUBLE AS e) GROUP BY e")
def effort_curve(t: Tables) -> DataFrame:
    return r6(xp.effort_curve(t.part, NAMES, {"p_size": 10.0}, [0.0, 0.25, 0.5, 1.0], model, 0.5), "detection")


@query("SELECT 0::DOUBLE AS violations")
def monotone_check(t: Tables) -> DataFrame:
    return xp.monotone_violations(t.part, NAMES, NAMES, [1.5, 3.0], model)


@query(f"""WITH pt AS (SELECT p_partkey AS i, p_size::DOUBLE AS a, p_retailprice AS b FROM part), d AS (SELECT i, avg({_m('a', 'b')}) AS jk, avg({_m('a', 'p_retailprice')}) AS j, avg({_m('p_size', 'b')}) AS k FROM part, pt GROUP BY i),
c AS (SELECT jk - avg(jk) OVER () AS x, j - avg(j) OVER () AS y, k - avg(k) OVER () AS z FROM d) SELECT round(sqrt(least(sum((x - y - z) ^ 2) / sum(x ^ 2), 1)), 5) AS h FROM c""")
def interaction_h(t: Tables) -> DataFrame:
    return xp.h_statistic(t.part, t.part, "p_size", "p_retailprice", NAMES, model).withColumn("h", F.round("h", 5))


@query(f"""WITH {EV}, a AS (SELECT *, row_number() OVER (ORDER BY event_id * 2654435761 % 4294967296, event_id) AS r, count(*) OVER () AS n FROM ev WHERE y = 1) SELECT FALSE AS poisoned, y, count(*) AS n, round(avg(value), 4) AS mean FROM ev GROUP BY y UNION ALL SELECT TRUE, 0, count(*), round(avg(7), 4) FROM a WHERE r <= floor(n * 0.1::DOUBLE)""")
def backdoor_poison(t: Tables) -> DataFrame:
    out = xp.poison(ev(t).select("event_id", "y", "value"), "event_id", "y", {"value": 7.0}, 0.1)
    return out.groupBy("poisoned", "y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query()
def spectral_signatures(t: Tables) -> DataFrame:
    width = t.embeddings.agg(F.max(F.size("embedding"))).first()[0]
    names = [f"e{i}" for i in range(width)]
    wide = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    return r6(xp.spectral_scores(wide, names).select("vec_id", "score"))


@query(f"WITH {EV}, c AS (SELECT *, abs(score - 0.1) <= 0.05 AS d1, abs(value / 400 - 0.1) <= 0.02 AS d2 FROM ev) SELECT CASE WHEN NOT d1 THEN 0 WHEN NOT d2 THEN 1 ELSE 2 END AS tier, CASE WHEN NOT d1 THEN score >= 0.1 WHEN NOT d2 THEN value / 400 >= 0.1 ELSE value / 300 >= 0.1 END AS decision, count(*) AS n, sum(CASE WHEN NOT d1 THEN 1 WHEN NOT d2 THEN 3 ELSE 9 END)::DOUBLE AS cost FROM c GROUP BY 1, 2")
def price_cascade(t: Tables) -> DataFrame:
    e = ev(t).withColumns({"s2": F.col("value") / 400, "s3": F.col("value") / 300})
    widths = iter((0.02, 0.05))
    out = xp.cascade(e, [("score", 0.1, 1), ("s2", 0.1, 3), ("s3", 0.1, 9)], lambda s, cut: F.abs(s - cut) <= next(widths))
    return out.groupBy("tier", "decision").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query(f"""WITH RECURSIVE {EV}, p AS (SELECT day, avg(score) AS psi FROM ev GROUP BY day), f AS (SELECT min(day) AS day FROM p WHERE psi >= 0.1 UNION ALL SELECT (SELECT min(p.day) FROM p WHERE psi >= 0.1 AND p.day >= f.day + 4) FROM f WHERE f.day IS NOT NULL) SELECT day::BIGINT AS day FROM f WHERE day IS NOT NULL""")
def retrain_schedule(t: Tables) -> DataFrame:
    return xp.retrain_schedule(ev(t).groupBy("day").agg(F.avg("score").alias("psi")), "day", 0.1, 4)


@query()
def priority_sampling(t: Tables) -> DataFrame:
    return xp.priority_probabilities(ev(t), "value", 0.05, 0.001).agg(F.round(F.sum("probability"), 3).alias("expected"), F.max("probability").alias("largest"), F.min("probability").alias("smallest"))
