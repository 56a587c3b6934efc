import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import kernels as k
from tidemark.streaming import scan, spool


def test_adwin_cuts_after_a_change_and_not_before():
    rng = np.random.default_rng(0)
    a = k.Adwin()
    calm = [a.step(float(x))[2] for x in rng.normal(0, 0.1, 1500)]
    assert not any(calm) and a.step(0.0)[0] == 1501 and len(a.buckets) < 80
    moved = [a.step(float(x))[2] for x in rng.normal(1, 0.1, 500)]
    assert any(moved[:64]) and a.step(1.0)[0] < 900 and abs(a.step(1.0)[1] - 1) < 0.1


@pytest.mark.parametrize("q", [0.1, 0.5, 0.95])
def test_p2_is_near_the_quantile(q):
    x = np.random.default_rng(1).lognormal(size=20_000)
    p = k.P2Quantile(q)
    for v in x:
        got = p.step(float(v))[0]
    assert abs((x <= got).mean() - q) < 0.01
    small = k.P2Quantile(0.5)
    assert [small.step(v)[0] for v in (3.0, 1.0, 2.0)] == [3.0, 2.0, 2.0]


def test_adaptive_levels_restore_coverage_under_shift():
    rng = np.random.default_rng(2)
    a = k.AdaptiveConformal(rng.uniform(0, 0.5, 500), rng.uniform(0, 0.5, 500), 0.1, 0.02)
    missed = [a.step(float(min(1, rng.uniform(0.3, 0.9))), 0)[2] for _ in range(4000)]
    assert abs(np.mean(missed[1000:]) - 0.1) < 0.02
    late = k.AdaptiveConformal([0.1] * 10, [0.1] * 10, 0.1, 0.5, delay=2)
    assert [late.step(1.0, 0)[3] for _ in range(3)] == [0.1, 0.1, pytest.approx(0.1 + 0.5 * (0.1 - 1))]
    assert k._rank_threshold([1, 2, 3], 0.0) == math.inf and k._rank_threshold([1, 2, 3], 1.0) == -math.inf


def test_experts_track_the_better_one():
    e = k.Experts(2, 1.0, 0.05)
    total = np.sum([e.step(0.0, 1.0) for _ in range(100)] + [e.step(1.0, 0.0) for _ in range(100)], axis=0)
    assert total[1] < total[0] and total[1] < 15


def test_controller_reaches_its_setpoint_and_limits_steps():
    c = k.LogRateController(50.0)
    rates = [-2.0]
    for _ in range(60):
        rates.append(c.step(10_000 * 10 ** rates[-1])[0])
    assert abs(10_000 * 10 ** rates[-1] - 50) < 5 and np.abs(np.diff(rates)).max() <= 0.15 + 1e-12


def test_bandit_learns_the_paying_action():
    rng = np.random.default_rng(3)
    b = k.LinearBandit(2)
    actions = []
    for _ in range(600):
        x = rng.random()
        actions.append((x > 0.5, b.step(1.0, x, 0.0, 1.0 if x > 0.5 else -1.0)[0]))
    assert np.mean([want == got for want, got in actions[200:]]) > 0.85


def test_tree_learns_a_threshold_and_reservoir_is_uniform():
    rng = np.random.default_rng(4)
    tree, wrong = k.HoeffdingTree(2), []
    for _ in range(3000):
        x = rng.random(2)
        y = int(x[0] > 0.6)
        wrong.append((tree.step(*x, y)[0] >= 0.5) != y)
    assert np.mean(wrong[2000:]) < 0.1 and "cut" in tree.root
    firsts = []
    for seed in range(300):
        r = k.Reservoir(5, seed)
        for i in range(50):
            r.step(i)
        firsts += [row[0] for row in r.rows]
    assert abs(np.mean(firsts) - 24.5) < 1.5


def brute_queue(arrivals, services, scores, servers, priority):
    events = [(a, 0, i) for i, a in enumerate(arrivals)]
    heapq.heapify(events)
    waits, waiting, free = [None] * len(arrivals), [], servers
    while events:
        t = events[0][0]
        while events and events[0][0] == t:
            _, kind, i = heapq.heappop(events)
            if kind:
                free += 1
            else:
                heapq.heappush(waiting, (-scores[i] if priority else 0, arrivals[i], i))
        while free and waiting:
            i = heapq.heappop(waiting)[-1]
            waits[i] = t - arrivals[i]
            free -= 1
            heapq.heappush(events, (t + services[i], 1, i))
    return waits


def test_queues_against_brute_force():
    rng = np.random.default_rng(5)
    for servers in (1, 2, 3):
        for priority in (False, True):
            n = 60
            args = rng.integers(0, 40, n).tolist(), rng.integers(1, 6, n).tolist(), rng.random(n).tolist()
            assert k.simulate_servers(*args, servers, priority) == brute_queue(*args, servers, priority)


def test_batching_by_hand():
    assert k.simulate_batching([0.0, 1.0, 1.5], 1.0, 1.0, 1, 0.0) == ([2.0, 3.0, 4.5], [1, 1, 1])
    latency, sizes = k.simulate_batching([0.0, 1.0, 1.5, 9.0], 1.0, 0.5, 4, 2.0)
    assert sizes == [3, 1] and latency == [4.5, 3.5, 3.0, 1.5]


def mean_kernel():
    class Mean:  # local, so that it travels by value
        def __init__(self):
            self.n, self.s = 0, 0.0

        def step(self, x):
            self.n, self.s = self.n + 1, self.s + x
            return (self.n, self.s / self.n)

    return Mean


def test_keyed_scan_equals_windows(spark, sf_dir):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    got = {r.event_id: (r.n, round(r.m, 9)) for r in scan.keyed_scan(e, "event_type", ["ts", "event_id"], ["value"], mean_kernel(), "n long, m double").collect()}
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.event_id: (r.n, round(r.m, 9)) for r in e.select("event_id", F.count(F.lit(1)).over(w).alias("n"), F.avg("value").over(w).alias("m")).collect()}
    assert got == want


def test_spool_scores_each_file_once(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    score = lambda df: df.select("*", (F.col("x") / 10).alias("attack_probability"), F.lit("DoS").alias("predicted_class"), (F.col("x") > 5).alias("is_attack"), F.lit(None).cast("string").alias("recommended_action"))
    for name, rows in (("a.csv", "x\n1\n9\n"), ("b.csv", "x\n8\n")):
        (src / name).write_text(rows)
        spool.watch(spool.read_spool(spark, str(src), "x int"), score, str(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.text(str(out)).count() == 2
    seen = spool.unseen_files(spark, str(src), None)
    assert seen.count() == 2 and spool.unseen_files(spark, str(src), seen.limit(1)).count() == 1


def test_drift_monitor_reports_full_windows(spark, tmp_path):
    ref = spark.range(2000).select((F.col("id") % 100).cast("double").alias("x"))
    (tmp_path / "s").mkdir()
    for i, shift in enumerate((0, 0, 50, 50)):
        ref.limit(300).select(F.col("x") + shift).toDF("x").coalesce(1).write.mode("append").json(str(tmp_path / "s" / str(i)))
    for i in (0, 0, 1, 2, 2, 3, 3):  # replayed batches, and a monitor that starts anew each time
        monitor = spool.DriftMonitor(ref, ["x"], str(tmp_path / "m"), window=500)
        monitor.observe(spark.read.schema("x double").json(str(tmp_path / "s" / str(i))), i)
    assert monitor.state(spark, 4) == (2, 4, 0) and monitor.state(spark, 3) == (1, 2, 300)
    got = {r["window"]: r.drift for r in spark.read.parquet(str(tmp_path / "m" / "reports")).collect()}
    assert got == {0: "none", 1: "major"}


def test_stream_windows_and_sessions(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))
    for name, df in (("w", spool.windowed_counts(stream, "ts", ["event_type"], "1 day", "1 day", "2 days")), ("s", spool.sessions(stream, "ts", ["user_id"], "2 hours", "1 hour"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete" if name == "w" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    assert spark.sql("SELECT sum(events) AS n FROM w").first().n == e.count()
    assert spark.sql("SELECT count(*) AS n FROM s").first().n > 0


def test_stream_kernel_state_lives_across_batches(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "k"
    for part in ([(1, 1, 1.0), (1, 2, 3.0), (2, 1, 5.0)], [(1, 3, 5.0)]):
        spark.createDataFrame(part, "k long, t long, x double").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("k long, t long, x double").parquet(str(src))
        out = scan.streaming_scan(stream, "k", "t", ["x"], mean_kernel(), "n long, m double")
        out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "o")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(1, 1, 1, 1.0), (1, 2, 2, 2.0), (1, 3, 3, 3.0), (2, 1, 1, 5.0)]
