"""Point-in-time context, host analytics, periodicity, incidents and episodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import is_internal, mix32, safe_rate


def as_of_context(df: DataFrame, entity: str, time_us: str, lookback_us: int, distinct: Sequence[str] = ()) -> DataFrame:
    """What an entity did in [t - lookback, t): count, distinct values, mean gap.

    The frame ends one microsecond before the row, so its own instant and ties
    with it are excluded. The mean gap of n events is their span over n - 1; of
    a single event the time since it; null without events.

    A value counts at t while its last occurrence before t is young enough: that
    is a span of time for each occurrence, so distinct values are a running sum
    of spans begun less spans ended, whatever the number of events in the
    lookback. Null values don't count. Rows shuffle on the entity, and once more
    for each distinct column.
    """
    w = Window.partitionBy(entity).orderBy(time_us).rangeBetween(-lookback_us, -1)
    n = F.count(F.lit(1)).over(w)
    lo, hi = F.min(time_us).over(w), F.max(time_us).over(w)
    gap = F.when(n > 1, (hi - lo) / (n - 1)).when(n == 1, (F.col(time_us) - hi).cast("double"))
    if not distinct:
        return df.withColumns({"ctx_events": n, "ctx_gap_us": gap})
    whole = df.withColumn("_own", F.lit(1))
    for i, c in enumerate(distinct):
        same = Window.partitionBy(entity, c).orderBy(time_us)
        t = F.col(time_us)
        until = F.least(t + lookback_us, F.min(t).over(same.rangeBetween(1, Window.unboundedFollowing)))
        spans = df.where(F.col(c).isNotNull()).select(entity, t, until.alias("_until"), F.lag(t).over(same).alias("_last")).where(F.col("_last").isNull() | (F.col("_last") < t))
        marks = F.array(F.struct(t.alias(time_us), F.lit(1).alias(f"_d{i}")), F.struct(F.col("_until").alias(time_us), F.lit(-1).alias(f"_d{i}")))
        whole = whole.unionByName(spans.select(entity, marks.alias("_m")).select(entity, F.inline("_m")), allowMissingColumns=True)
    before = Window.partitionBy(entity).orderBy(time_us).rangeBetween(Window.unboundedPreceding, -1)
    held = {f"ctx_{c}": F.coalesce(F.sum(f"_d{i}").over(before), F.lit(0)).cast("int") for i, c in enumerate(distinct)}
    counted = whole.withColumns(held).where("_own = 1").select(*df.columns, *held)
    return counted.withColumns({"ctx_events": n, "ctx_gap_us": gap}).select(*df.columns, "ctx_events", *held, "ctx_gap_us")


def leaky_context(df: DataFrame, entity: str, distinct: Sequence[str] = ()) -> DataFrame:
    """Whole-history aggregates joined back: the leak that :func:`as_of_context` avoids. Null entities get null."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("all_events"), *[F.count_distinct(c).alias(f"all_{c}") for c in distinct])
    return df.join(per, entity, "left")


def leakage_gap(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Mean of the leaky column over mean of the as-of column; infinite at 0."""
    means = df.agg(*[F.avg(c).alias(c) for pair in pairs for c in pair])
    ratio = [F.when(F.col(b) != 0, F.col(a) / F.col(b)).otherwise(float("inf")).alias(f"{a}_gap") for a, b in pairs]
    return means.select(*ratio)


def inter_arrivals(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """Gaps between consecutive events of a group."""
    gap = F.col(time) - F.lag(time).over(Window.partitionBy(*by).orderBy(time))
    return df.select(*by, gap.alias("gap")).where(F.col("gap").isNotNull())


def beacons(df: DataFrame, by: Sequence[str], time: str, min_events: int) -> DataFrame:
    """Regular pairs: score = clip(1 - MAD / median of gaps), with period, dispersion and count.

    Two medians per pair: of the gaps, then of their distance to it. Pairs with
    fewer than ``min_events`` events are left out; a median of 0 scores 0.
    """
    by = list(by)
    gaps = inter_arrivals(df, by, time)
    centre = gaps.groupBy(*by).agg(F.percentile("gap", 0.5).alias("median"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), (F.count(F.lit(1)) + 1).alias("events")).where(F.col("events") >= min_events)
    spread = gaps.join(centre.select(*by, "median"), by).groupBy(*by).agg(F.percentile(F.abs(F.col("gap") - F.col("median")), 0.5).alias("mad"))
    score = F.when(F.col("median") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("mad") / F.col("median")))).otherwise(0.0)
    return centre.join(spread, by).select(*by, "events", F.col("median").alias("period"), safe_rate(F.col("sd"), F.col("mean")).alias("cv"), score.alias("score"))


def scans(df: DataFrame, source: str, target: str, port: str, min_fanout: int) -> DataFrame:
    """Sources with many targets or ports: horizontal or vertical scans."""
    per = df.groupBy(source).agg(F.count_distinct(target).alias("targets"), F.count_distinct(port).alias("ports"), F.count(F.lit(1)).alias("flows"))
    wide = F.greatest("targets", "ports")
    kind = F.when(F.col("targets") >= F.col("ports"), "horizontal").otherwise("vertical")
    return per.where(wide >= min_fanout).withColumns({"fanout": wide, "kind": kind})


def adjacency(df: DataFrame, source: str, target: str) -> DataFrame:
    """Distinct directed edges without loops."""
    return df.select(F.col(source).alias("src"), F.col(target).alias("dst")).where("src <> dst").distinct()


def lateral_chains(edges: DataFrame, max_depth: int, min_hosts: int, internal_only: bool = True, max_starts: int | None = None) -> DataFrame:
    """The longest simple path from each entry node, at most ``max_depth`` hops; later hops stay internal.

    Entry nodes have no edge into them; if there are none, all nodes count.
    Ties go to the lexicographically smallest path. Paths grow by one join per
    hop. ``max_starts`` bounds the entry nodes (by name) where asked for.
    """
    starts = edges.select(F.col("src").alias("start")).distinct().join(edges.select(F.col("dst").alias("start")).distinct(), "start", "left_anti")
    if starts.isEmpty():
        starts = edges.select(F.col("src").alias("start")).union(edges.select("dst")).distinct()
    if max_starts is not None:
        starts = starts.orderBy("start").limit(max_starts)
    hop = edges.where(is_internal(F.col("dst"))) if internal_only else edges
    path = starts.select("start", F.array("start").alias("path"))
    longest = path
    for depth in range(max_depth):
        step = edges if depth == 0 else hop
        path = path.join(step, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select("start", F.concat("path", F.array("dst")).alias("path"))
        longest = longest.unionByName(path)
    best = longest.groupBy("start").agg(F.min(F.struct((-F.size("path")).alias("n"), "path")).alias("b")).select("start", F.col("b.path").alias("path"))
    chains = best.where(F.size("path") >= min_hosts)
    # the proper parts of a chain are few (at most max_depth squared), so chains within chains are found by equality
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size("path")), lambda a: F.transform(F.sequence(a, F.size("path")), lambda b: F.slice("path", a, b - a + 1))))
    parts = chains.select(F.size("path").alias("whole"), F.explode(spans).alias("part")).where(F.size("part") < F.col("whole")).select("part").distinct()
    return chains.join(parts, F.col("path") == F.col("part"), "left_anti").withColumn("hosts", F.size("path"))


def incidents(df: DataFrame, order: Sequence[str], alert: Column, label: str, tolerance: int, by: Sequence[str] = ()) -> DataFrame:
    """Runs of alerts of one class with at most ``tolerance`` quiet rows between: adds incident (1, 2, ...).

    Positions count all rows of the stream; only alert rows are returned.
    """
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    placed = df.withColumn("pos", F.row_number().over(whole.orderBy(*order)) - 1).where(alert)
    w = whole.orderBy("pos")
    new = F.when((F.lag(label).over(w).isNull()) | (F.lag(label).over(w) != F.col(label)) | (F.col("pos") - F.lag("pos").over(w) - 1 > tolerance), 1).otherwise(0)
    return placed.withColumn("_new", new).withColumn("incident", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def incident_report(found: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per incident: class, span, size, peak and mean score."""
    return found.groupBy(*by, "incident").agg(F.min(label).alias(label), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("alerts"), F.max(score).alias("peak"), F.avg(score).alias("mean"))


def top_values(found: DataFrame, by: Sequence[str], value: str, order: str, k: int) -> DataFrame:
    """The ``k`` most frequent values per group, ties by first appearance."""
    counted = found.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first_seen"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)


def episodes(df: DataFrame, day: str, label: str, order: Sequence[str], alert: Column, length: int) -> DataFrame:
    """Bursts of ``length`` consecutive flows of a class and day: time of the first alert, or censored at the end.

    A last burst of fewer than two flows is dropped.
    """
    place = F.row_number().over(Window.partitionBy(day, label).orderBy(*order)) - 1
    held = df.withColumn("_rn", place).withColumns({"episode": F.floor(F.col("_rn") / length), "_at": F.col("_rn") % length + 1})
    first = F.min(F.when(alert, F.col("_at")))
    per = held.groupBy(day, label, "episode").agg(F.count(F.lit(1)).alias("n"), first.alias("_first")).where("n >= 2")
    return per.select(day, label, "episode", F.coalesce("_first", "n").cast("long").alias("time"), F.col("_first").isNotNull().cast("int").alias("event"))


def sessions(df: DataFrame, by: Sequence[str], time: str, gap: int) -> DataFrame:
    """Sessions that end with a pause longer than ``gap``: adds session (1, 2, ...) per group."""
    w = Window.partitionBy(*by).orderBy(time)
    new = F.when(F.coalesce(F.col(time) - F.lag(time).over(w) > gap, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def active_idle(df: DataFrame, by: Sequence[str], time: str, timeout: int) -> DataFrame:
    """Active spans (longer than 0) and idle gaps of each group's timeline, cut at pauses over ``timeout``."""
    marked = sessions(df, by, time, timeout)
    spans = marked.groupBy(*by, "session").agg(F.min(time).alias("a"), F.max(time).alias("b"))
    idle = F.col("a") - F.lag("b").over(Window.partitionBy(*by).orderBy("session"))
    return spans.withColumns({"span": F.col("b") - F.col("a"), "idle": idle}).groupBy(*by).agg(
        F.count_if(F.col("span") > 0).alias("active_spans"), F.avg(F.when(F.col("span") > 0, F.col("span"))).alias("active_mean"), F.count("idle").alias("idle_gaps"), F.avg("idle").alias("idle_mean"), F.max("idle").alias("idle_max")
    )


#: Rows of an index that are broadcast at a time.
INDEX_ROWS = 20_000


def exemplars(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` rows of each class, picked by a hash of the key."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(mix32(F.col(key)), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= per_class).drop("_rank")


def ranked(index: DataFrame, queries: DataFrame, key: str, vector: str) -> DataFrame:
    """All rows of the index but the query itself by Euclidean distance from each query, ties by key: query, neighbour, distance, rank.

    As many rows as pairs; an index that is small should be broadcast.
    """
    small = index.select(F.col(key).alias("neighbour"), F.col(vector).alias("_v"))
    square = F.aggregate(F.zip_with(vector, "_v", lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    near = queries.crossJoin(small).where(F.col(key) != F.col("neighbour")).select(F.col(key).alias("query"), "neighbour", F.sqrt(square).alias("distance"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour")))


def nearest(index: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    """Exact k nearest rows of an index for each query, by Euclidean distance, ties by key.

    The index (exemplars) is counted and broadcast in blocks of at most
    ``INDEX_ROWS``; queries stay where they are, and each block leaves k rows a
    query.
    """
    blocks = -(-index.count() // INDEX_ROWS) or 1
    if blocks == 1:
        return ranked(F.broadcast(index), queries, key, vector).where(F.col("rank") <= k)
    found = None
    for b in range(blocks):
        block = index.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        best = ranked(F.broadcast(block), queries, key, vector).where(F.col("rank") <= k)
        found = best if found is None else found.unionByName(best)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))).where(F.col("rank") <= k)


def knn_shapley(near: DataFrame, k: int) -> DataFrame:
    """Mean Shapley value of each training row for a k-NN vote.

    ``near``: query, neighbour, rank (over all training rows), match (0/1).
    s_N = m_N / N and s_i = s_(i+1) + (m_i - m_(i+1)) / K * min(K, i) / i.
    """
    w = Window.partitionBy("query").orderBy("rank")
    whole = Window.partitionBy("query")
    nxt = F.lead("match").over(w)
    step = F.when(nxt.isNull(), F.col("match") / F.max("rank").over(whole)).otherwise((F.col("match") - nxt) / float(k) * F.least(F.lit(k), F.col("rank")) / F.col("rank"))
    back = Window.partitionBy("query").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    return near.withColumn("step", step).withColumn("value", F.sum("step").over(back)).groupBy("neighbour").agg(F.avg("value").alias("value"))
