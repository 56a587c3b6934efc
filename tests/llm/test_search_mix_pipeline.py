import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import mixing, pivot_index
from tidemark.llm.common import Scratch, table

NAN, INF = float("nan"), float("inf")


def brute_topk(rows, k):
    good = [(i, np.floor(256 * np.array(v, dtype=np.float64)).astype(int)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, x in good:
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for i, y in good if i != q)[:k]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def search(df, k=5):
    got = {}
    for r in pivot_index.top_k(df, df.where(F.col("vec_id") % 50 == 0), k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_topk_of_the_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    assert search(table(spark, sf_dir, "embeddings")) == brute_topk(rows, 5)


def test_topk_with_bad_vectors_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 16)
    monkeypatch.setattr(pivot_index, "CHUNK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4) * rng.choice([0.01, 1, 5])]) for i in range(200)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(120)]  # a group of copies
    rows += [(3000, None), (3001, [None, 1.0, 1.0, 1.0]), (3050, [NAN, 1.0, 1.0, 1.0]), (3002, [INF, 0.0, 0.0, 0.0]), (3003, []), (None, [1.0, 1.0, 1.0, 1.0]), (3100, [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert search(df) == brute_topk(rows, 5)
    few = df.where("vec_id in (0, 1, 50)")
    assert search(few) == brute_topk([r for r in rows if r[0] in (0, 1, 50)], 5)
    assert search(df.limit(0)) == {} and search(df.where("vec_id = 3000")) == {}


def test_topk_over_several_rings_and_lengths(spark, monkeypatch):
    """Clustered vectors of very different length: several rings and ranges, most annuli never visited, results exact."""
    for name, value in (("PIVOTS", 8), ("BLOCK", 16), ("CHUNK", 5), ("ROUNDS", (1, 2))):
        monkeypatch.setattr(pivot_index, name, value)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 6)) * 4
    rows = [(i, [float(x) for x in (centres[i % 8] + rng.normal(size=6) * 0.2) * (0.4, 1.0, 1.3)[i % 3]]) for i in range(2400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = pivot_index.PivotIndex(pivot_index.quantise(df, "vec_id", "embedding", 256), 5, Scratch(spark, "t"))
    rings = {int(r) % pivot_index.RINGS for r in index.directory[:, 1]}
    assert len(index.tops) > 1 and len(rings) > 1 and (np.diff(index.directory[:, 2:4], axis=1) >= 0).all()
    best = index.search(pivot_index.quantise(df.where("vec_id % 50 = 0"), "vec_id", "embedding", 256))
    got = {}
    for r in best.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert {q: sorted(v) for q, v in got.items()} == brute_topk(rows, 5)
    assert 0 < index.visits[0] < 0.6 * index.possible


def brute_shares(children, budget):
    """Water filling of whole numbers: {name: given} from [(name, supply, weight)]."""
    given, open_, left = {}, sorted(children, key=lambda c: (c[1] / c[2], c[0])), budget
    while open_:
        weight = sum(c[2] for c in open_)
        short = [c for c in open_ if c[1] * weight <= c[2] * left]
        if not short:
            break
        name, supply, _ = short[0]
        given[name], left = supply, left - supply
        open_ = [c for c in open_ if c[0] != name]
    weight = sum(c[2] for c in open_)
    parts = {n: w * left // weight for n, _, w in open_}
    for n in sorted(parts)[: left - sum(parts.values())]:
        parts[n] += 1
    return {**given, **parts}


@pytest.mark.parametrize("total", [0, 1, 57, 100, 333, 1000, 10**6])
def test_budgets_reach_siblings_before_ancestors(spark, total):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 200), ("a", "y", "1", 5), ("b", "x", "1", 1), ("b", "z", "9", 90), ("", "z", "", 0)]
    weights = {("a",): 3, ("b",): 2, ("a", "x"): 1, ("a", "y"): 7, ("a", "x", "2"): 2}
    df = spark.createDataFrame(leaves, "d string, l string, s string, tokens long")
    got = {(r.d, r.l, r.s): r.budget for r in mixing.leaf_budgets(df, ["d", "l", "s"], weights, total, 2).collect()}
    supply = Counter()
    for *path, n in leaves:
        for k in range(4):
            supply[tuple(path[:k])] += 2 * n
    budget = {(): min(total, supply[()])}
    for k in range(3):
        for parent in [p for p in supply if len(p) == k]:
            kids = [(p[-1], supply[p], weights.get(p, 1)) for p in supply if len(p) == k + 1 and p[:k] == parent]
            budget |= {(*parent, n): b for n, b in brute_shares(kids, budget[parent]).items()}
    assert got == {p: b for p, b in budget.items() if len(p) == 3}
    assert sum(got.values()) == min(total, supply[()])


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_prefixes_of_seeded_epochs(spark, docs):
    rows = [(i, " ".join(["w"] * (i * 7 % 13)), "en" if i % 3 else None, f"src{i % 4}", i) for i in range(60)] + [(60, None, "de", None, 0), (None, "a b", "en", "src1", 0), (7, "a b", "en", "src1", 0)]
    levels = mixing.document_levels()
    for total, epochs in ((None, 2), (150, 3), (900, 3)):
        got = mixing.mix(docs(rows), levels, mixing.DOCUMENT_WEIGHTS, total=total, max_epochs=epochs, seed=3).collect()
        scratch = Scratch(spark, "t")
        flat = docs(rows).select("doc_id", *[F.coalesce(c, F.lit("")).alias(k) for k, c in levels.items()], mixing.token_count(F.col("text")).alias("tokens"))
        plan = {(r.domain, r.lang, r.source): r for r in mixing.plan_mix(flat, list(levels), mixing.DOCUMENT_WEIGHTS, scratch, total, epochs, 3).collect()}
        assert sum(p.budget for p in plan.values()) == min(total or 10**9, sum(words(r[1]) for r in rows) * (1 if total is None else epochs))
        want = Counter()
        for (domain, lang, source), p in plan.items():
            leaf = [r for r in rows if ((r[2] or ""), (r[3] or "")) == (lang, source) and ("web" if re.match("^src[0-9]$", r[3] or "") else "curated") == domain]
            for e in range(p.epochs):
                want.update((r[0], e, words(r[1])) for r in leaf)
            at = 0
            for r in sorted(leaf, key=lambda r: (hashlib.md5(f"3:{p.epochs}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, words(r[1]))):
                if at < p.rest:
                    want[(r[0], p.epochs, min(words(r[1]), p.rest - at))] += 1
                at += words(r[1])
        assert Counter((r.doc_id, r.mix_epoch, r.mix_taken) for r in got) == want
    assert mixing.mix(docs([]), levels, {}).count() == 0


def test_mixture_with_clashing_columns(docs):
    rows = [(i, "a b c", "en", "src1", 0) for i in range(6)]
    wide = docs(rows)
    names = ("mix_tokens", "MIX_EPOCH", "_mix_domain", "_mixed_key", "_mixed_rest", "tokens", "a.b")
    for n in names:
        wide = wide.withColumn(n, F.concat(F.lit(n), "doc_id"))
    alone = mixing.mix(wide, mixing.document_levels(), mixing.DOCUMENT_WEIGHTS, annotate=False)
    assert alone.columns == wide.columns and alone.count() == 6
    assert all(r[n] == f"{n}{r.doc_id}" for r in alone.collect() for n in names)
    told = mixing.mix(wide, mixing.document_levels(), mixing.DOCUMENT_WEIGHTS)
    assert told.columns == [c for c in wide.columns if c not in names[:2]] + ["mix_epoch", "mix_tokens", "mix_taken"]
    assert {(r.mix_epoch, r.mix_tokens, r["a.b"] == f"a.b{r.doc_id}") for r in told.collect()} == {(0, 3, True)}
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(wide, mixing.document_levels(), {("web",): 0})


def test_pipeline_against_its_parts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    frames = {}
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        frames[name] = docs.collect()
        assert docs.columns == columns or name == "best_fit_packing"
    first = {r.doc_id for r in frames["language_id"]}
    assert first == {d for d, r in kept.items() if re.search(r"[^\W\d_]", r.text or "")}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    smallest = {}
    for d in sorted(first):
        smallest.setdefault(kept[d].text.translate(low), d)
    assert sorted(r.doc_id for r in frames["exact_dedup"]) == sorted(smallest.values())
    import sys

    sys.path.insert(0, __file__.rpartition("/")[0])
    from test_near_dedup import brute

    classes = brute([(d, kept[d].text) for d in smallest.values()], 5, 80)
    near = sorted(d for d, (_, root) in classes.items() if d == root)
    assert sorted(r.doc_id for r in frames["near_dedup"]) == near
    mixed = Counter(r.doc_id for r in frames["source_mixing"])
    assert mixed.keys() <= set(near) and max(mixed.values()) <= 2
    packed = frames["best_fit_packing"]
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed
    ends = Counter()
    for r in packed:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length").collect())) == sorted(str(r) for r in docs.select("doc_id", "piece", "length").collect())
