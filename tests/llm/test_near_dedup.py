import random
import re

import numpy as np
import pytest

from tidemark.llm import components, near_dedup
from tidemark.llm.common import Scratch, table
from tidemark.llm.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_sets(rows, width):
    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        out[doc] = set(zip(*[w[i:] for i in range(width)])) if len(w) >= width else ({tuple(w)} if w else set())
    return out


def brute(rows, width, percent):
    """Reference components by comparing all pairs."""
    sets = brute_sets(rows, width)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(spark_docs, rows, width, percent):
    want = brute(rows, width, percent)
    got = near_dedup.near_duplicate_classes(spark_docs(rows), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_odd_rows(docs):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one"), (3, "ONE"), (9, "two words"), (10, "Two  words"), (11, "words two"), (12, "a b c"), (13, "A\tB\nC"), (14, "\x00 b c"), (15, "é b c"), (16, "É b c"), (17, "w " * 5000)]
    check(docs, rows, 3, 85)
    check(docs, rows, 5, 80)


def test_null_ids_repeats_and_empty(docs):
    got = near_dedup.near_duplicate_classes(docs([(None, "a b c"), (4, "a b c"), (4, "a b c"), (9, "a b c")]), 3, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (4, 4, True), (4, 4, True), (9, 4, False)]
    assert near_dedup.near_duplicate_classes(docs([])).count() == 0


def test_borderline_group_loses_no_link(docs):
    """Copies with edits lie around the threshold of each other, so hubs link only some of them."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice((2, 3, 4, 5))):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[i : i + 60] + [f"y{rng.randrange(10**6)}" for _ in range(50)])) for i in range(40)]
    check(docs, rows, 3, 85)


@pytest.mark.parametrize(("block", "size"), [(16, 4 << 20), (1024, 1 << 12)])
def test_large_buckets_lose_no_link(docs, monkeypatch, block, size):
    """Two texts and their edited copies, short and long, in buckets of several blocks by rows or by bytes."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", size)
    rng = random.Random(6)
    rows, base = [], [f"w{rng.randrange(5000)}" for _ in range(900)]
    for k, n in ((0, 100), (1, 900)):
        for i in range(70):
            words = base[:n]
            for _ in range(n // 30 if i else 0):
                words[rng.randrange(n)] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * k + (i * 37) % 70, " ".join(words)))
    check(docs, rows, 3, 85)


def edited(rng, base, edits, words=10**6):
    """``base`` with as many words replaced by others."""
    out = list(base)
    for k in rng.sample(range(len(base)), edits):
        out[k] = f"x{rng.randrange(words)}"
    return " ".join(out)


@pytest.mark.parametrize(("seed", "fan", "percent"), [(1, 32, 85), (2, 3, 85), (3, 100, 70), (4, 0, 85)])
def test_large_groups_lose_no_link(docs, monkeypatch, seed, fan, percent):
    """Texts edited alike, around the threshold of each other, with and without the text they come from, on lists of one and more shared shingles."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "FAN", fan)
    monkeypatch.setattr(near_dedup, "STRIP", 7)
    rng = random.Random(seed)
    rows = []
    for k in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(100)]
        rows += [(1000 * k + i, edited(rng, base[: 100 - i % 9], rng.choice((2, 3, 3, 4, 6)), 3)) for i in range(60)]
        if k == 1:
            rows.append((5000, " ".join(base)))
    check(docs, rows, 3, percent)


def test_rows_grow_with_the_size_of_a_group(spark, docs, monkeypatch):
    """Four times as many texts that are alike but under the threshold write about four times the rows, not sixteen times."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, 5)) for i in range(400)]
    written = {}
    put = Scratch.put

    def counted(self, df, name):
        out = put(self, df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "put", counted)
    made = []
    for n in (100, 400):
        written.clear()
        near_dedup.near_duplicate_classes(docs(rows[:n]), 3, 85).count()
        made.append((max(written.values()), sum(written.values())))
    assert made[1][0] <= 6 * made[0][0] and made[1][1] <= 6 * made[0][1]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d", 1, 2), (2, "a b c d", 3, 4)], "doc_id long, text string, rep long, kept int")
    assert [tuple(r) for r in near_dedup.drop_near_duplicates(df).collect()] == [(1, "a b c d", 1, 2)]
    df = df.withColumnsRenamed({"rep": "_gone", "kept": "a.b"})
    assert [tuple(r) for r in near_dedup.drop_near_duplicates(df).collect()] == [(1, "a b c d", 1, 2)]


def test_whole_small_table(spark, sf_dir):
    from tidemark.llm.queries import op4_near_dedup

    want = brute([(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op4_near_dedup(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 0.85, 0.95])
def test_estimate_is_near_the_similarity(share):
    rng = np.random.default_rng(7)
    gaps = []
    for n in (8, 100, 3000):
        for _ in range(20):
            common = rng.integers(1, 1 << 63, round(n * share), dtype=np.uint64)
            a, b = (np.concatenate([common, rng.integers(1, 1 << 63, (n - len(common)) // 2 + 1, dtype=np.uint64)]) for _ in "ab")
            regs = near_dedup.registers([a, b])
            true = len(common) / (len(a) + len(b) - len(common))
            est = near_dedup.estimate(np.array([(regs[0] == regs[1]).sum()]), np.array([len(a)]), np.array([len(b)]))[0]
            gaps.append(est - true)
    assert abs(np.mean(gaps)) < 0.02 and np.abs(gaps).max() < 5 * 0.045


def test_slabs_and_widths_agree():
    text = " ".join(f"word{i % 977} éü{i}" for i in range(20000))
    whole = near_dedup.shingle_sets([text], 5)[0]
    old, near_dedup.SLAB = near_dedup.SLAB, 1000
    try:
        assert np.array_equal(near_dedup.shingle_sets(["x", text, ""], 5)[1], whole)
    finally:
        near_dedup.SLAB = old
    assert len(whole) == len(brute_sets([(0, text)], 5)[0])


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (None, 3)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(root)}


@pytest.mark.parametrize("most", [0, 500_000])
def test_components_on_the_driver_and_in_rounds(spark, monkeypatch, most):
    """Random links, a path with its ends inside, a star around its largest node and repeats: both ways agree with a search."""
    monkeypatch.setattr(components, "DRIVER_LINKS", most)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    path = [1000 + rng.randrange(10**6) for _ in range(64)]
    links += [*zip(path, path[1:]), *((2 * 10**6, 10**6 + 5000 * i) for i in range(300, 340)), (-5, 2**62), (2**62, -5), (9, 9), (None, 1)]
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x] if x not in want else []
        while todo:
            if (y := todo.pop()) not in want:
                want[y] = x
                todo += near[y]
    rows = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").collect() == []


@pytest.mark.parametrize("percent", [85, 70])
def test_large_groups_without_memory_or_broadcasts(docs, monkeypatch, percent):
    """The ways for what is too large for the driver or a broadcast find the same classes."""
    monkeypatch.setattr(components, "DRIVER_LINKS", 0)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    monkeypatch.setattr(near_dedup, "BROADCAST_BUCKETS", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, rng.choice((2, 3, 4)), 3)) for i in range(50)] + [(100 + i, edited(rng, base[:60], 2)) for i in range(12)]
    rows += [(7, " ".join(base[:60])), (7, " ".join(base[40:])), (200, " ".join(base[:58]))]
    got = near_dedup.near_duplicate_classes(docs(rows[:-3]), 3, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows[:-3], 3, percent)
    one = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_classes(docs(rows), 3, percent).collect()}
    assert one[7] == one[200] == min(x for x in one if one[x] == one[200])


def test_a_run_has_few_tasks(spark, docs, monkeypatch):
    """With a large group of copies that no hub links, the number of shuffles decides how long many small partitions take."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, edited(rng, base, 5)) for i in range(200)] + [(1000 + i, edited(rng, base[:70], 1)) for i in range(20)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    context = spark.sparkContext
    try:
        for k, v in zip(old, ("40", "false", "256k"), strict=True):
            spark.conf.set(k, v)
        context.setJobGroup("few-tasks", "few tasks")
        near_dedup.near_duplicate_classes(docs(rows), 3, 85).count()
    finally:
        context._jsc.clearJobGroup()
        for k, v in old.items():
            spark.conf.set(k, v)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    done = sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))
    assert 500 < done < 1800
