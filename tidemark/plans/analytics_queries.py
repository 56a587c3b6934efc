"""Queries of the sketch, governance, learning and model operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.operators import governance as gv
from tidemark.operators import learning as ln
from tidemark.operators import sketches as sk
from tidemark.plans.ranking_queries import EV, LI, ev, li, r6
from tidemark.plans.registry import Tables, query

W, D = 272, 5
CM = "cm AS (" + " UNION ALL ".join(f"SELECT {r} AS row, ((user_id % 2147483647 * {48271 + 7919 * r} + {69621 + 104729 * r}) % 2147483647 % {W})::INTEGER AS cell, user_id FROM events" for r in range(D)) + ")"


@query(f"WITH {CM} SELECT row, cell, count(*) AS n FROM cm GROUP BY row, cell")
def count_min(t: Tables) -> DataFrame:
    return sk.count_min(t.events, "user_id", W, D)


@query(f"WITH {CM}, c AS (SELECT row, cell, count(*) AS n FROM cm GROUP BY row, cell) SELECT user_id, min(n) AS estimate FROM (SELECT DISTINCT row, cell, user_id FROM cm) JOIN c USING (row, cell) GROUP BY user_id")
def count_min_query(t: Tables) -> DataFrame:
    return sk.count_min_query(sk.count_min(t.events, "user_id", W, D), t.events.select("user_id").distinct(), "user_id", W, D)


@query()
def hyperloglog(t: Tables) -> DataFrame:
    return sk.cardinality(sk.registers(t.lineitem, "l_orderkey", 12), 12)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 0.0101 * (SELECT count(*) FROM lineitem)")
def heavy_hitters(t: Tables) -> DataFrame:
    return sk.heavy_hitters(t.lineitem, "l_suppkey", 0.0101)


@query()
def approx_heavy_hitters(t: Tables) -> DataFrame:
    return sk.approx_heavy_hitters(t.lineitem, "l_suppkey", 10)


@query("SELECT event_id FROM events ORDER BY (event_id + 7) * 2654435761 % 4294967296, event_id LIMIT 100")
def reservoir(t: Tables) -> DataFrame:
    return sk.reservoir(t.events, "event_id", 100).select("event_id")


@query("""WITH h AS (SELECT least(greatest(floor((value - 0) / 0.5::DOUBLE), 0), 999)::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS cum, sum(n) OVER () AS tot FROM h)
SELECT round(0.5 * (bin + (0.95::DOUBLE * tot - (cum - n)) / n), 6) AS quantile FROM c WHERE cum >= 0.95::DOUBLE * tot ORDER BY bin LIMIT 1""")
def histogram_quantile(t: Tables) -> DataFrame:
    return r6(sk.histogram_quantile(t.events, "value", 0.0, 500.0, 1000, 0.95))


@query(f"WITH {EV}, r AS (SELECT label, value, row_number() OVER (PARTITION BY label ORDER BY value) AS i, count(*) OVER (PARTITION BY label) AS n FROM ev) SELECT label, min(value) FILTER (i >= ceil(0.99::DOUBLE * n)) AS quantile FROM r GROUP BY label")
def exact_quantile(t: Tables) -> DataFrame:
    return sk.exact_quantile(ev(t), "value", 0.99, ["label"])


@query()
def kll_quantile(t: Tables) -> DataFrame:
    return sk.kll_quantile(t.events, "value", 0.99)


# --- governance ---------------------------------------------------------------------------------


def _ledger(t: Tables) -> DataFrame:
    return gv.seal(t.events, "user_id", "event_id", "props", "ts")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') END AS st, sha256(replace(props, ' ', '')) AS ph FROM events),
c AS (SELECT user_id, seq, sha256('1|0|' || st || '|' || repeat('0', 64) || '|' || ph) AS h FROM e WHERE seq = 0 UNION ALL SELECT e.user_id, e.seq, sha256('1|' || e.seq || '|' || st || '|' || h || '|' || ph) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
SELECT user_id::VARCHAR AS ledger, max(seq) + 1 AS entries, arg_max(h, seq) AS head FROM c GROUP BY user_id""")
def ledger_heads(t: Tables) -> DataFrame:
    return _ledger(t).groupBy("ledger").agg((F.max("seq") + 1).alias("entries"), F.max_by("entry_hash", "seq").alias("head"))


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT user_id::VARCHAR AS ledger, n AS entries, CASE WHEN user_id = 3 THEN 5 WHEN user_id = 5 THEN 8 END::BIGINT AS bad_seq, CASE WHEN user_id = 3 THEN 'payload' WHEN user_id = 5 THEN 'entry' END AS failure, user_id NOT IN (3, 5) AS ok FROM n""")
def ledger_verify(t: Tables) -> DataFrame:
    bad = _ledger(t).withColumns({
        "payload": F.when((F.col("ledger") == "3") & (F.col("seq") == 5), "{}").otherwise(F.col("payload")),
        "recorded_at": F.when((F.col("ledger") == "5") & (F.col("seq") == 8), "1970").otherwise(F.col("recorded_at")),
    })
    return gv.verify(bad).drop("head")


@query("""WITH RECURSIVE l AS (SELECT o_orderpriority AS g, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, sha256(o_orderkey::VARCHAR) AS h, 0 AS d FROM orders),
t AS (SELECT g, d, list(h ORDER BY i) AS hs FROM l GROUP BY g, d UNION ALL SELECT g, d + 1, [CASE WHEN 2 * k + 2 <= len(hs) THEN sha256(hs[2 * k + 1] || hs[2 * k + 2]) ELSE hs[2 * k + 1] END for k in range((len(hs) + 1) // 2)] FROM t WHERE len(hs) > 1)
SELECT g AS o_orderpriority, hs[1] AS root FROM t WHERE len(hs) = 1""")
def merkle_roots(t: Tables) -> DataFrame:
    leaves = t.orders.withColumn("leaf", F.sha2(F.col("o_orderkey").cast("string"), 256))
    return gv.merkle_levels(leaves, "o_orderpriority", "o_orderkey", "leaf")


# --- learning -----------------------------------------------------------------------------------

UPD = "u AS (SELECT label AS site, avg(e) AS value, pos FROM (SELECT label, unnest(embedding) AS e, unnest(range(64)) AS pos FROM embeddings) GROUP BY label, pos), s AS (SELECT label AS site, count(*) AS n FROM embeddings GROUP BY label)"


def _updates(t: Tables) -> DataFrame:
    return ln.explode_updates(t.embeddings, "label", "embedding").groupBy("site", "pos").agg(F.avg("value").alias("value"))


@query(f"WITH {UPD} SELECT pos::INTEGER AS pos, round(sum(value * n) / sum(n), 6) AS value FROM u JOIN s USING (site) GROUP BY pos")
def fedavg(t: Tables) -> DataFrame:
    return r6(ln.federated_average(_updates(t), t.embeddings.groupBy(F.col("label").alias("site")).agg(F.count(F.lit(1)).alias("n"))))


@query(f"WITH {UPD} SELECT pos::INTEGER AS pos, round(median(value), 6) AS value FROM u GROUP BY pos")
def coordinate_median(t: Tables) -> DataFrame:
    return r6(ln.coordinate_median(_updates(t)))


@query(f"WITH {UPD}, r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY value, site) AS r, count(*) OVER (PARTITION BY pos) AS n FROM u) SELECT pos::INTEGER AS pos, round(avg(value), 6) AS value FROM r WHERE r > 2 AND r <= n - 2 GROUP BY pos")
def trimmed_mean(t: Tables) -> DataFrame:
    return r6(ln.trimmed_mean(_updates(t), 2))


@query(f"""WITH {UPD}, d AS (SELECT a.site AS a, b.site AS b, sum((a.value - b.value) ^ 2) AS d FROM u a JOIN u b USING (pos) WHERE a.site <> b.site GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r, count(*) OVER (PARTITION BY a) + 1 AS n FROM d),
k AS (SELECT a AS site, sum(d) AS score FROM r WHERE r <= n - 2 - 2 GROUP BY a) SELECT site, round(score, 6) AS score, row_number() OVER (ORDER BY k.score, site) = 1 AS chosen FROM k""")
def krum(t: Tables) -> DataFrame:
    return r6(ln.krum(_updates(t), 2))


@query(f"WITH {EV}, l AS (SELECT label, -(y * ln(least(1 - 1e-12::DOUBLE, greatest(1e-12::DOUBLE, score))) + (1 - y) * ln(1 - least(1 - 1e-12::DOUBLE, greatest(1e-12::DOUBLE, score)))) AS x FROM ev), g AS (SELECT label, avg(x) AS loss, count(*) AS n FROM l GROUP BY label) SELECT label, round(loss, 6) AS loss, n, row_number() OVER (ORDER BY g.loss DESC, label) = 1 AS worst FROM g")
def group_losses(t: Tables) -> DataFrame:
    return r6(ln.group_losses(ev(t), "label", sc.log_loss(F.col("score"), F.col("y"))))


@query(f"WITH {EV}, g AS (SELECT label, avg(score) AS loss FROM ev GROUP BY label) SELECT label, round(0.2::DOUBLE * exp(2 * loss) / sum(0.2::DOUBLE * exp(2 * loss)) OVER (), 6) AS new_weight FROM g")
def group_weights(t: Tables) -> DataFrame:
    losses = ln.group_losses(ev(t), "label", F.col("score")).withColumn("w", F.lit(0.2))
    return r6(ln.exponentiated_gradient(losses, "w", 2.0).select("label", "new_weight"))


@query(f"""WITH {LI}, c AS (SELECT day, label, avg(score) - 0.5::DOUBLE AS s FROM li GROUP BY day, label) SELECT label AS feature, round(avg(abs(s)), 6) AS magnitude, round(abs(avg(sign(s))), 6) AS agreement, round(stddev_pop(s) / abs(avg(s)), 6) AS dispersion, count(*) AS environments FROM c GROUP BY label""")
def feature_stability(t: Tables) -> DataFrame:
    c = li(t).groupBy("day", F.col("label").alias("feature")).agg((F.avg("score") - 0.5).alias("strength"))
    return r6(ln.feature_stability(c))


@query(f"WITH {LI}, r AS (SELECT day, label, avg(score) AS v FROM li GROUP BY day, label) SELECT label, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(max(v) - min(v), 6) AS range, count(*) AS runs FROM r GROUP BY label")
def seed_summary(t: Tables) -> DataFrame:
    return r6(ln.seed_summary(li(t).groupBy("day", "label").agg(F.avg("score").alias("v")), "label", "v"))


@query(f"""WITH {LI}, f AS (SELECT ((score >= 0.45) <> (score >= 0.5))::INT AS a, ((score >= 0.55) <> (score >= 0.5))::INT AS b, ((score >= 0.6) <> (score >= 0.5))::INT AS c FROM li) SELECT round(avg(greatest(a, b, c)), 6) AS ambiguity, round(greatest(avg(a), avg(b), avg(c)), 6) AS discrepancy FROM f""")
def multiplicity(t: Tables) -> DataFrame:
    s = F.col("score")
    df = li(t).select((s >= 0.5).cast("int").alias("champion"), F.array(*[(s >= x).cast("int") for x in (0.45, 0.55, 0.6)]).alias("d"))
    return r6(ln.multiplicity(df, "champion", "d"))


@query(f"""WITH {LI}, v AS (SELECT y, ((score >= 0.45)::INT + (score >= 0.55)::INT + (score >= 0.6)::INT) / 3::DOUBLE AS v FROM li) SELECT CASE WHEN v > 0.7 THEN 'alert' WHEN v >= 0.3 THEN 'review' ELSE 'clear' END AS route, count(*) AS n, sum(y)::BIGINT AS attacks FROM v GROUP BY 1""")
def vote_routes(t: Tables) -> DataFrame:
    s = F.col("score")
    votes = sum(((s >= x).cast("int") for x in (0.45, 0.55, 0.6)), F.lit(0)) / 3.0
    return li(t).groupBy(ln.vote_route(votes, 0.3, 0.7).alias("route")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("attacks"))


RATES = {"r1": (0.6, 0.2), "r2": (0.3, 0.05)}


@query("""WITH v AS (SELECT l_quantity >= 40 AS r1, l_discount >= 0.09 AS r2, count(*) AS n FROM lineitem GROUP BY ALL) SELECT r1, r2, n, round(1 / (1 + exp(-(ln(0.1::DOUBLE / 0.9::DOUBLE) + CASE WHEN r1 THEN ln(0.6::DOUBLE / 0.2::DOUBLE) ELSE ln(0.4::DOUBLE / 0.8::DOUBLE) END + CASE WHEN r2 THEN ln(0.3::DOUBLE / 0.05::DOUBLE) ELSE ln(0.7::DOUBLE / 0.95::DOUBLE) END))), 6) AS posterior FROM v""")
def weak_label_posterior(t: Tables) -> DataFrame:
    v = ln.vote_patterns(t.lineitem.select((F.col("l_quantity") >= 40).alias("r1"), (F.col("l_discount") >= 0.09).alias("r2")), ["r1", "r2"])
    return r6(v.withColumn("posterior", ln.naive_posterior(RATES, 0.1)))


@query(f"""WITH {EV}, s AS (SELECT event_id, score, CASE WHEN score >= 0.4::DOUBLE THEN 1 WHEN score <= 0.02::DOUBLE THEN 0 END AS pseudo FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY pseudo ORDER BY CASE WHEN pseudo = 1 THEN -score ELSE score END, event_id) AS r FROM s WHERE pseudo IS NOT NULL) SELECT event_id, pseudo FROM r WHERE r <= 50""")
def pseudo_labels(t: Tables) -> DataFrame:
    return ln.pseudo_labels(ev(t), "score", "event_id", 0.4, 0.02, 50).select("event_id", "pseudo")


@query(f"WITH {EV} SELECT event_id, round(least(score / 0.4::DOUBLE, 1), 6) AS corrected, round(least(1, greatest(0, (0.6::DOUBLE / 0.4::DOUBLE) * least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, score)) / (1 - least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, score))))), 6) AS weight FROM ev")
def pu_learning(t: Tables) -> DataFrame:
    s = F.col("score")
    return r6(ev(t).select("event_id", ln.pu_correct(s, 0.4).alias("corrected"), ln.pu_weight(s, 0.4).alias("weight")))


@query(f"""WITH {LI}, p AS (SELECT label AS defence, day / 2001::DOUBLE AS f, avg((score >= 0.4)::INT) AS d FROM li GROUP BY label, day), u AS (SELECT defence, (f - 0.997) * 100 AS fraction, d AS detection, (1 - d) * pow(1 - (f - 0.997) * 100, 2) AS utility FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY defence ORDER BY utility DESC, fraction) AS r FROM u) SELECT defence, round(fraction, 6) AS fraction, round(detection, 6) AS detection, round(utility, 6) AS utility, row_number() OVER (ORDER BY b.detection DESC, defence) = 1 AS chosen FROM b WHERE r = 1""")
def stackelberg(t: Tables) -> DataFrame:
    p = li(t).groupBy(F.col("label").alias("defence"), "day").agg(F.avg((F.col("score") >= 0.4).cast("double")).alias("detection"))
    p = p.select("defence", ((F.col("day") / 2001.0 - 0.997) * 100).alias("fraction"), "detection")
    return r6(ln.stackelberg(p, 2.0))


@query("SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size <= a.p_size AND b.p_retailprice >= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice > a.p_retailprice))")
def pareto_front(t: Tables) -> DataFrame:
    return ln.pareto_front(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice")


@query("""WITH f AS (SELECT s_suppkey, s_nationkey::DOUBLE AS a, s_acctbal AS b FROM supplier), c AS (SELECT s_suppkey, CASE WHEN lag(a) OVER x IS NULL OR lead(a) OVER x IS NULL THEN 'inf'::DOUBLE ELSE (lead(a) OVER x - lag(a) OVER x) / (max(a) OVER () - min(a) OVER ()) END AS p, CASE WHEN lag(b) OVER y IS NULL OR lead(b) OVER y IS NULL THEN 'inf'::DOUBLE ELSE (lead(b) OVER y - lag(b) OVER y) / (max(b) OVER () - min(b) OVER ()) END AS q FROM f WINDOW x AS (ORDER BY a, s_suppkey), y AS (ORDER BY b, s_suppkey))
SELECT s_suppkey, CASE WHEN isinf(p + q) THEN 'inf'::DOUBLE ELSE round(p + q, 6) END AS crowding FROM c""")
def crowding_distance(t: Tables) -> DataFrame:
    f = t.supplier.select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), F.col("s_acctbal").alias("b"))
    c = F.col("crowding")
    return ln.crowding(f, ["a", "b"], "s_suppkey").select("s_suppkey", F.when(c == float("inf"), c).otherwise(F.round(c, 6)).alias("crowding"))


@query("WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r, sum(n) OVER (PARTITION BY p_brand) AS s FROM c) SELECT p_brand, s::BIGINT AS size, p_type AS dominant, round(n / s::DOUBLE, 6) AS purity FROM r WHERE r = 1")
def cluster_purity(t: Tables) -> DataFrame:
    return r6(ln.cluster_purity(t.part, "p_brand", "p_type"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS a, round(regr_slope(l_extendedprice, l_quantity), 4) AS b FROM lineitem")
def affine_fit(t: Tables) -> DataFrame:
    return ln.affine_fit(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("a", 3).alias("a"), F.round("b", 4).alias("b"))


@query("""WITH l AS (SELECT p_partkey, unnest([{'feature': 'p_size', 'contribution': 0.5::DOUBLE * (p_size - 25)}, {'feature': 'p_retailprice', 'contribution': -0.01::DOUBLE * (p_retailprice - 1000)}, {'feature': 'p_partkey2', 'contribution': 0.003::DOUBLE * (p_partkey - 900)}], recursive := true) FROM part),
r AS (SELECT p_partkey, feature, contribution, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(contribution) DESC, feature) AS rank FROM l) SELECT p_partkey, feature, round(contribution, 6) AS contribution, rank::INTEGER AS rank FROM r WHERE rank <= 2""")
def linear_attribution(t: Tables) -> DataFrame:
    df = t.part.withColumn("p_partkey2", F.col("p_partkey"))
    return r6(ln.linear_attribution(df, "p_partkey", {"p_size": 0.5, "p_retailprice": -0.01, "p_partkey2": 0.003}, {"p_size": 25, "p_retailprice": 1000, "p_partkey2": 900}, 2))


def _mi_sql(a: str, b: str) -> str:
    return f"""(WITH j AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY x) / sum(n) OVER () AS px, sum(n) OVER (PARTITION BY y) / sum(n) OVER () AS py FROM j)
SELECT '{a}' AS a, '{b}' AS b, round(sum(p * ln(p / (px * py))), 8) AS mi FROM p)"""


@query(f"{_mi_sql('l_returnflag', 'l_linestatus')} UNION ALL {_mi_sql('l_linenumber', 'l_returnflag')}")
def mutual_information(t: Tables) -> DataFrame:
    out = ln.mutual_information(t.lineitem, [("l_returnflag", "l_linestatus"), ("l_linenumber", "l_returnflag")])
    return out.withColumn("mi", F.round("mi", 8))
