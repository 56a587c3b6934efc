"""Queries of the context, host, incident, cleaning and split operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.operators import cleaning as cl
from tidemark.operators import context as cx
from tidemark.operators import models as md
from tidemark.plans.ranking_queries import EV, LI, ev, li, r6
from tidemark.plans.registry import Tables, query

DAY_US = 86_400_000_000
ASOF = f"""WITH {EV}, c AS (SELECT event_id, count(*) OVER w AS ctx_events, len(list_distinct(coalesce(list(label) OVER w, [])))::INTEGER AS ctx_label, us, max(us) OVER w AS hi, min(us) OVER w AS lo
 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {DAY_US} PRECEDING AND 1 PRECEDING))"""


@query(ASOF + " SELECT event_id, ctx_events, ctx_label, round(CASE WHEN ctx_events > 1 THEN (hi - lo) / (ctx_events - 1)::DOUBLE WHEN ctx_events = 1 THEN (us - hi)::DOUBLE END, 3) AS ctx_gap_us FROM c")
def asof_context(t: Tables) -> DataFrame:
    return cx.as_of_context(ev(t), "user_id", "us", DAY_US, ["label"]).select("event_id", "ctx_events", "ctx_label", F.round("ctx_gap_us", 3).alias("ctx_gap_us"))


@query(f"WITH {EV} SELECT event_id, count(*) OVER (PARTITION BY user_id) AS all_events, (SELECT count(DISTINCT label) FROM ev b WHERE b.user_id = ev.user_id) AS all_label FROM ev")
def leaky_context(t: Tables) -> DataFrame:
    return cx.leaky_context(ev(t), "user_id", ["label"]).select("event_id", "all_events", "all_label")


@query(ASOF + " SELECT round((SELECT avg(n) FROM (SELECT count(*) OVER (PARTITION BY user_id) AS n FROM ev)) / avg(ctx_events), 6) AS all_events_gap FROM c")
def leakage_gap(t: Tables) -> DataFrame:
    both = cx.leaky_context(cx.as_of_context(ev(t), "user_id", "us", DAY_US), "user_id")
    return r6(cx.leakage_gap(both, [("all_events", "ctx_events")]))


@query(f"""WITH {EV}, g AS (SELECT user_id, label, us - lag(us) OVER (PARTITION BY user_id, label ORDER BY us) AS gap FROM ev), m AS (SELECT user_id, label, median(gap) AS md, avg(gap) AS mean, stddev_pop(gap) AS sd, count(gap) + 1 AS events FROM g WHERE gap IS NOT NULL GROUP BY ALL HAVING count(gap) + 1 >= 8),
s AS (SELECT user_id, label, median(abs(gap - md)) AS mad FROM g JOIN m USING (user_id, label) WHERE gap IS NOT NULL GROUP BY ALL)
SELECT user_id, label, events, round(md, 3) AS period, round(sd / mean, 6) AS cv, round(CASE WHEN md > 0 THEN greatest(0, least(1, 1 - mad / md)) ELSE 0 END, 6) AS score FROM m JOIN s USING (user_id, label)""")
def beacon_pairs(t: Tables) -> DataFrame:
    out = cx.beacons(ev(t), ["user_id", "label"], "us", 8)
    return out.withColumns({"period": F.round("period", 3), "cv": F.round("cv", 6), "score": F.round("score", 6)})


@query("""SELECT l_suppkey, count(DISTINCT l_partkey) AS targets, count(DISTINCT l_linenumber) AS ports, count(*) AS flows, greatest(targets, ports) AS fanout, CASE WHEN targets >= ports THEN 'horizontal' ELSE 'vertical' END AS kind
FROM lineitem GROUP BY l_suppkey HAVING greatest(count(DISTINCT l_partkey), count(DISTINCT l_linenumber)) >= 500""")
def scan_fanout(t: Tables) -> DataFrame:
    return cx.scans(t.lineitem, "l_suppkey", "l_partkey", "l_linenumber", 500)


@query("SELECT DISTINCT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM customer JOIN supplier ON c_custkey % 100 = s_suppkey WHERE c_nationkey <> s_nationkey")
def adjacency(t: Tables) -> DataFrame:
    pairs = t.customer.join(t.supplier, F.col("c_custkey") % 100 == F.col("s_suppkey"))
    return cx.adjacency(pairs.select(F.col("c_nationkey").cast("long"), F.col("s_nationkey").cast("long")), "c_nationkey", "s_nationkey")


HOSTS = """e0 AS (SELECT s_nationkey AS a, (s_nationkey * 3 + s_suppkey) % 9 + 30 AS b FROM supplier UNION SELECT (s_nationkey + s_suppkey) % 9 + 30, (s_nationkey * 5 + s_suppkey) % 9 + 30 FROM supplier),
e AS (SELECT DISTINCT (CASE WHEN a < 30 THEN '203.0.113.' ELSE '10.0.0.' END) || a AS src, '10.0.0.' || b AS dst FROM e0 WHERE a <> b)"""


def _hosts(t: Tables) -> DataFrame:
    s = t.supplier
    first = s.select(F.col("s_nationkey").cast("long").alias("a"), ((F.col("s_nationkey") * 3 + F.col("s_suppkey")) % 9 + 30).alias("b"))
    second = s.select(((F.col("s_nationkey") + F.col("s_suppkey")) % 9 + 30).alias("a"), ((F.col("s_nationkey") * 5 + F.col("s_suppkey")) % 9 + 30).alias("b"))
    e = first.union(second)
    src = F.concat(F.when(F.col("a") < 30, "203.0.113.").otherwise("10.0.0."), F.col("a").cast("string"))
    return cx.adjacency(e.select(src.alias("s"), F.concat(F.lit("10.0.0."), F.col("b").cast("string")).alias("d")), "s", "d")


@query(f"""WITH RECURSIVE {HOSTS}, starts AS (SELECT DISTINCT src AS start FROM e WHERE src NOT IN (SELECT dst FROM e)),
p AS (SELECT start, [start] AS path FROM starts UNION ALL SELECT start, list_append(path, dst) FROM p JOIN e ON path[-1] = src WHERE len(path) <= 4 AND NOT list_contains(path, dst)),
b AS (SELECT start, path FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(path) DESC, path) AS r FROM p) WHERE r = 1 AND len(path) >= 3)
SELECT start, array_to_string(path, '>') AS path, len(path)::INTEGER AS hosts FROM b""")
def lateral_chains(t: Tables) -> DataFrame:
    return cx.lateral_chains(_hosts(t), max_depth=4, min_hosts=3).withColumn("path", F.concat_ws(">", "path"))


INC = f"""WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM ev), a AS (SELECT * FROM p WHERE value >= 60),
n AS (SELECT *, CASE WHEN lag(label) OVER w IS NULL OR lag(label) OVER w <> label OR pos - lag(pos) OVER w - 1 > 3 THEN 1 ELSE 0 END AS nw FROM a WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
i AS (SELECT *, (sum(nw) OVER (PARTITION BY user_id ORDER BY pos))::BIGINT AS incident FROM n)"""


def _incidents(t: Tables) -> DataFrame:
    return cx.incidents(ev(t), ["ts", "event_id"], F.col("value") >= 60, "label", 3, by=["user_id"])


@query(INC + " SELECT event_id, user_id, pos::INTEGER AS pos, incident FROM i")
def incidents(t: Tables) -> DataFrame:
    return _incidents(t).select("event_id", "user_id", "pos", "incident")


@query(INC + " SELECT user_id, incident, min(label) AS label, min(pos)::INTEGER AS first_pos, max(pos)::INTEGER AS last_pos, count(*) AS alerts, round(max(score), 6) AS peak, round(avg(score), 6) AS mean FROM i GROUP BY user_id, incident")
def incident_report(t: Tables) -> DataFrame:
    return r6(cx.incident_report(_incidents(t), "label", "score", ["user_id"]))


@query(INC + """, c AS (SELECT user_id, label, count(*) AS n, min(pos)::INTEGER AS first_seen FROM i GROUP BY ALL)
SELECT user_id, label, n, first_seen, r::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_seen) AS r FROM c) WHERE r <= 2""")
def incident_top_classes(t: Tables) -> DataFrame:
    return cx.top_values(_incidents(t), ["user_id"], "label", "pos", 2)


EPI = f"""{EV}, q AS (SELECT *, row_number() OVER (PARTITION BY day, label ORDER BY ts, event_id) - 1 AS rn FROM ev),
b AS (SELECT day, label, rn // 10 AS episode, count(*) AS n, min(CASE WHEN value >= 150 THEN rn % 10 + 1 END) AS f FROM q GROUP BY ALL HAVING count(*) >= 2),
ep AS (SELECT day, label, episode, coalesce(f, n)::BIGINT AS time, (f IS NOT NULL)::INTEGER AS event FROM b)"""


@query(f"WITH {EPI} SELECT * FROM ep")
def episodes(t: Tables) -> DataFrame:
    return cx.episodes(ev(t), "day", "label", ["ts", "event_id"], F.col("value") >= 150, 10)


SESS = f"""WITH {EV}, n AS (SELECT *, CASE WHEN coalesce(us - lag(us) OVER w > 7200000000, TRUE) THEN 1 ELSE 0 END AS nw FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM n)"""


@query(SESS + " SELECT user_id, session, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY ALL")
def session_totals(t: Tables) -> DataFrame:
    return cx.sessions(ev(t), ["user_id"], "us", 7_200_000_000).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query(SESS + """, p AS (SELECT user_id, session, min(us) AS a, max(us) AS b FROM s GROUP BY ALL), q AS (SELECT *, b - a AS span, a - lag(b) OVER (PARTITION BY user_id ORDER BY session) AS idle FROM p)
SELECT user_id, count(*) FILTER (span > 0) AS active_spans, round(avg(span) FILTER (span > 0), 3) AS active_mean, count(idle) AS idle_gaps, round(avg(idle), 3) AS idle_mean, max(idle) AS idle_max FROM q GROUP BY user_id""")
def active_idle(t: Tables) -> DataFrame:
    out = cx.active_idle(ev(t), ["user_id"], "us", 7_200_000_000)
    return out.withColumns({"active_mean": F.round("active_mean", 3), "idle_mean": F.round("idle_mean", 3)})


KNN = """x AS (SELECT vec_id, embedding AS e, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id * 2654435761 % 4294967296, vec_id) AS r FROM embeddings) WHERE r <= 20),
d AS (SELECT q.vec_id AS query, x.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], x.e::DOUBLE[]) AS distance, q.label AS ql, x.label AS xl FROM embeddings q, x WHERE q.vec_id <> x.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM d)"""


def _near(t: Tables, k: int) -> DataFrame:
    return cx.nearest(cx.exemplars(t.embeddings, "label", "vec_id", 20), t.embeddings, k, "vec_id", "embedding")


@query(f"WITH {KNN} SELECT query, neighbour, round(distance, 5) AS distance, rank::INTEGER AS rank FROM k WHERE rank <= 5")
def knn_exemplars(t: Tables) -> DataFrame:
    return _near(t, 5).withColumn("distance", F.round("distance", 5))


@query(f"WITH {KNN} SELECT query, avg((xl = ql)::INT) > 0.5 AS supported FROM k WHERE rank <= 5 GROUP BY query")
def exemplar_support(t: Tables) -> DataFrame:
    labels = t.embeddings.select("vec_id", "label")
    near = _near(t, 5).join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(labels.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("xl")), "neighbour")
    return near.groupBy("query").agg((F.avg((F.col("ql") == F.col("xl")).cast("double")) > 0.5).alias("supported"))


@query(f"""WITH {KNN.replace("WHERE r <= 20)", ")").replace("WHERE q.vec_id <> x.vec_id)", "WHERE q.vec_id <> x.vec_id AND q.vec_id % 50 = 0)")}, m AS (SELECT *, (ql = xl)::INT AS m, lead((ql = xl)::INT) OVER w AS nx, max(rank) OVER (PARTITION BY query) AS n FROM k WINDOW w AS (PARTITION BY query ORDER BY rank)),
s AS (SELECT *, CASE WHEN nx IS NULL THEN m / n::DOUBLE ELSE (m - nx) / 5::DOUBLE * least(5, rank) / rank END AS st FROM m), v AS (SELECT neighbour, sum(st) OVER (PARTITION BY query ORDER BY rank DESC) AS v FROM s)
SELECT neighbour, round(avg(v), 6) AS value FROM v GROUP BY neighbour""")
def knn_shapley(t: Tables) -> DataFrame:
    """The value of every embedding for a vote on the query set: the rows whose id is divisible by 50."""
    labels = t.embeddings.select("vec_id", "label")
    near = cx.ranked(t.embeddings, t.embeddings.where("vec_id % 50 = 0"), "vec_id", "embedding").join(labels.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(labels.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("xl")), "neighbour")
    return r6(cx.knn_shapley(near.withColumn("match", (F.col("ql") == F.col("xl")).cast("int")), 5))


# --- cleaning -----------------------------------------------------------------------------------


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(p_name, ' ', '  ') || ' – ' || p_type, '[–—‑\u0096]', '-', 'g'), '\\s+', ' ', 'g')) AS label FROM part""")
def clean_labels(t: Tables) -> DataFrame:
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("  ")), F.lit(" – "), F.col("p_type"))
    return t.part.select("p_partkey", sc.normalize_label(raw).alias("label"))


@query("SELECT CASE p_type WHEN 'ECONOMY' THEN 'LOW' WHEN 'PROMO' THEN 'LOW' ELSE p_type END AS kind, count(*) AS n FROM part GROUP BY 1")
def consolidate_labels(t: Tables) -> DataFrame:
    return t.part.groupBy(sc.consolidate(F.col("p_type"), {"ECONOMY": "LOW", "PROMO": "LOW"}).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, try_cast(props::JSON ->> '$.k' AS DOUBLE) AS k, CASE WHEN (props::JSON ->> '$.k')::DOUBLE <> 42 THEN (props::JSON ->> '$.k')::DOUBLE END AS k2 FROM events""")
def coerce_props(t: Tables) -> DataFrame:
    k = sc.coerce_number(F.get_json_object("props", "$.k"))
    return t.events.select("event_id", k.alias("k"), sc.sentinel_to_null(k, 42.0).alias("k2"))


@query("SELECT DISTINCT p_brand, p_type, p_size FROM part")
def dedup_rows(t: Tables) -> DataFrame:
    return t.part.select("p_brand", "p_type", "p_size").dropDuplicates()


@query("""WITH c AS (SELECT p_brand AS label, p_type, p_size FROM part), d AS (SELECT sum(n - 1) / (SELECT count(*) FROM c)::DOUBLE AS x FROM (SELECT count(*) AS n FROM c GROUP BY label, p_type, p_size))
SELECT 'rows' AS name, count(*)::DOUBLE AS measured, 1::DOUBLE AS required, count(*) > 0 AS ok FROM c UNION ALL SELECT 'missing_columns', 1, 0, FALSE
UNION ALL SELECT 'unknown_labels', count(*), 0, count(*) = 0 FROM c WHERE label NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT 'null_share', 0, 0.5, TRUE
UNION ALL SELECT 'duplicate_share', round(x, 6), 0.2, x <= 0.2 FROM d UNION ALL SELECT 'classes', count(DISTINCT label), 2, count(DISTINCT label) >= 2 FROM c""")
def quality_gate(t: Tables) -> DataFrame:
    c = t.part.select(F.col("p_brand").alias("label"), "p_type", "p_size")
    return r6(cl.quality_gate(c, ["label", "p_type", "p_size", "absent"], "label", ["Brand#1", "Brand#2"]), "measured")


U = "((o_orderkey * 2654435761 % 4294967296 + 7 * 40503) % 4294967296 * 69069 + o_orderkey) % 4294967296 / 4294967296::DOUBLE"


@query(f"""WITH d AS (SELECT o_orderkey, o_orderstatus, year(o_orderdate) >= 2000 AS te, {U} AS u FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY te, o_orderstatus ORDER BY u, o_orderkey) AS r, count(*) OVER (PARTITION BY te, o_orderstatus) AS n FROM d)
SELECT o_orderkey, CASE WHEN te THEN 'test' WHEN r <= floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM r""")
def temporal_split(t: Tables) -> DataFrame:
    o = t.orders.withColumn("day", F.year("o_orderdate"))
    return cl.temporal_split(o, "day", [2000, 2001, 2002], "o_orderkey", 0.2, "o_orderstatus").select("o_orderkey", "part")


STRAT = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {U}, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
p AS (SELECT *, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' WHEN r <= floor(n * 0.2::DOUBLE) + floor((n - floor(n * 0.2::DOUBLE)) * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS part FROM r)"""


@query(STRAT + " SELECT o_orderkey, part FROM p")
def stratified_split(t: Tables) -> DataFrame:
    return cl.stratified_split(t.orders, "o_orderpriority", "o_orderkey").select("o_orderkey", "part")


@query("SELECT 0::BIGINT AS shared")
def disjoint_check(t: Tables) -> DataFrame:
    p = cl.stratified_split(t.orders, "o_orderpriority", "o_orderkey").select("o_orderkey", "part")
    return cl.overlap(p.where("part = 'train'"), p.where("part <> 'train'"), "o_orderkey")


@query(STRAT + """ SELECT part, o_orderstatus, count(*) AS n FROM (SELECT o_orderstatus, part FROM p WHERE o_orderstatus <> 'P' AND (part <> 'test' OR o_orderstatus = 'O') UNION ALL SELECT o_orderstatus, 'test' FROM p WHERE o_orderstatus = 'P') GROUP BY ALL""")
def leave_one_out(t: Tables) -> DataFrame:
    p = cl.stratified_split(t.orders, "o_orderpriority", "o_orderkey").select("o_orderstatus", "part")
    return cl.leave_one_out(p, "o_orderstatus", "P", "O").groupBy("part", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


RULES = {"big": [("l_quantity", "ge", 45.0), ("l_discount", "le", 0.02)], "taxed": [("l_tax", "ge", 0.07)], "absent": [("no_such", "ge", 1.0)]}


def _rules(t: Tables) -> DataFrame:
    return cl.rule_matrix(t.lineitem.withColumn("y", F.when(F.col("l_returnflag") == "R", 1).otherwise(0)), RULES)


@query("""SELECT l_quantity >= 45 AND l_discount <= 0.02 AS rule_big, l_tax >= 0.07 AS rule_taxed, FALSE AS rule_absent, (l_quantity >= 45 AND l_discount <= 0.02) OR l_tax >= 0.07 AS rule_any,
round(((l_quantity >= 45 AND l_discount <= 0.02)::INT + (l_tax >= 0.07)::INT) / 3::DOUBLE, 6) AS rule_score, count(*) AS n FROM lineitem GROUP BY ALL""")
def rules_matrix(t: Tables) -> DataFrame:
    return r6(_rules(t)).groupBy("rule_big", "rule_taxed", "rule_absent", "rule_any", "rule_score").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_linestatus AS c, (l_returnflag = 'R')::INT AS y, unnest([{'rule': 'big', 'f': l_quantity >= 45 AND l_discount <= 0.02}, {'rule': 'taxed', 'f': l_tax >= 0.07}, {'rule': 'absent', 'f': FALSE}], recursive := true) FROM lineitem),
b AS (SELECT rule, count(*) FILTER (f) AS fired, count(*) FILTER (f AND y = 1) AS tp, sum(y) AS a FROM l GROUP BY rule),
k AS (SELECT rule, c, row_number() OVER (PARTITION BY rule ORDER BY count(*) DESC, c) AS r FROM l WHERE f AND y = 1 GROUP BY rule, c)
SELECT rule, fired, round(coalesce(tp / nullif(fired, 0)::DOUBLE, 0), 6) AS precision, round(tp / a::DOUBLE, 6) AS recall, coalesce(c, '-') AS dominant FROM b LEFT JOIN (SELECT * FROM k WHERE r = 1) USING (rule)""")
def rule_stats(t: Tables) -> DataFrame:
    return r6(cl.rule_statistics(_rules(t), list(RULES), "l_linestatus"))


@query("""SELECT l_orderkey, l_linenumber, s_nationkey AS service, CASE WHEN s_nationkey < 5 THEN 0.3::DOUBLE ELSE 0.6::DOUBLE END AS threshold, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL""")
def service_thresholds(t: Tables) -> DataFrame:
    dim = t.spark.createDataFrame([(k, 0.3) for k in range(5)], "service int, threshold double")
    joined = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).withColumnRenamed("s_nationkey", "service")
    out = md.with_thresholds(joined, "service", dim, 0.6)
    return out.groupBy("l_orderkey", "l_linenumber", "service", "threshold").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH d AS (SELECT o_orderkey, o_orderstatus, {U} AS u FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY u, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM d)
SELECT o_orderkey FROM r WHERE r <= greatest(1, floor(n * 0.1::DOUBLE))""")
def subsample(t: Tables) -> DataFrame:
    return cl.subsample(t.orders, "o_orderstatus", "o_orderkey", 0.1).select("o_orderkey")


@query(f"""WITH d AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, {U} AS u FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY u, o_orderkey) AS r, count(*) OVER (PARTITION BY y) AS n FROM d)
SELECT y = 1 AND r <= floor(n * 0.05::DOUBLE) AS flipped, CASE WHEN y = 1 AND r <= floor(n * 0.05::DOUBLE) THEN 0 ELSE y END AS y, count(*) AS n FROM r GROUP BY ALL""")
def poison_flips(t: Tables) -> DataFrame:
    o = t.orders.withColumn("y", (F.col("o_orderstatus") == "F").cast("int"))
    return cl.flip_labels(o, "y", "o_orderkey", 0.05).groupBy("flipped", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT floor({U} * 8)::INTEGER AS shard, count(*) AS n, count(*) FILTER (o_orderkey % 500 = 0) AS deleted FROM orders GROUP BY 1")
def unlearning_shards(t: Tables) -> DataFrame:
    return cl.assign_shards(t.orders, "o_orderkey", 8).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 500 == 0).alias("deleted"))


PORTS = " ".join(f"WHEN {port} THEN '{name}'" for port, name in sc.SERVICES.items())


@query(f"WITH {LI} SELECT l_suppkey, CASE l_suppkey {PORTS} ELSE '{sc.OTHER_SERVICE}' END AS service, count(*) AS n FROM li GROUP BY ALL")
def port_services(t: Tables) -> DataFrame:
    return li(t).groupBy("l_suppkey", sc.service_of(F.col("l_suppkey")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, round(sign(value - 50) * ln(1 + abs(value - 50)), 6) AS signed, round(sign(value - 50) * (exp(abs(sign(value - 50) * ln(1 + abs(value - 50)))) - 1), 4) AS back,
1 + (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS level, CASE WHEN value = 0 THEN value ELSE round_even(value * pow(10, 2 - 1 - floor(log10(abs(value)))), 0) / pow(10, 2 - 1 - floor(log10(abs(value)))) END AS two,
round_even(100 * least(1, greatest(0, value / 200)), 0)::INTEGER AS severity FROM events""")
def scalar_transforms(t: Tables) -> DataFrame:
    v = F.col("value")
    return t.events.select("event_id", F.round(sc.signed_log(v - 50), 6).alias("signed"), F.round(sc.inverse_signed_log(sc.signed_log(v - 50)), 4).alias("back"), sc.bucket_of(v, [10, 50, 100]).alias("level"), sc.round_significant(v, 2).alias("two"), sc.severity(v / 200).alias("severity"))


@query("""WITH h AS (SELECT event_id, (event_id * 37 % 256) || '.' || (event_id * 17 % 300) || '.' || (event_id % 256) || '.1' AS host FROM events)
SELECT event_id, host, (split_part(host, '.', 2)::INT <= 255) AND (split_part(host, '.', 1) = '10' OR (split_part(host, '.', 1) = '172' AND split_part(host, '.', 2)::INT BETWEEN 16 AND 31) OR (split_part(host, '.', 1) = '192' AND split_part(host, '.', 2) = '168')) AS internal FROM h""")
def internal_hosts(t: Tables) -> DataFrame:
    i = F.col("event_id")
    host = F.concat_ws(".", (i * 37 % 256).cast("string"), (i * 17 % 300).cast("string"), (i % 256).cast("string"), F.lit("1"))
    return t.events.select("event_id", host.alias("host"), sc.is_internal(host).alias("internal"))
