import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_store, tokens
from tidemark.llm.common import table
from tidemark.llm.tokens import WordEncoder, public_path

PATH = public_path("byte_bpe_50k.json")
ODD = ["", None, " ", "a  b", " a b", "a b ", "a\n b", "x <|endoftext|> y", "é  b c", "don't 's a's", "a b c d", "\n\n", "word " * 3000 + "end"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def words():
    with open(PATH, "rb") as f:
        return WordEncoder(f.read())


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.text(alphabet=" \n\tab'sé1., Ü", max_size=30), max_size=5))
def test_word_cache_equals_whole_texts(words, texts):
    t = Tokenizer.from_file(PATH) if not hasattr(test_word_cache_equals_whole_texts, "t") else test_word_cache_equals_whole_texts.t
    test_word_cache_equals_whole_texts.t = t
    ids, edges = words.encode(pa.array(texts, pa.string()))
    assert len(edges) == len(texts) + 1
    for text, a, b in zip(texts, edges, edges[1:], strict=False):
        assert ids[a:b].tolist() == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano_round_trip_and_select(values):
    values = sorted(values)
    raw = token_store.ef_encode(np.array(values, dtype=np.uint64))
    assert token_store.ef_decode(raw).tolist() == values
    assert [int(token_store.ef_select(raw, i)[0]) for i in range(len(values))] == values
    some = np.arange(len(values))[::-3]
    assert token_store.ef_select(raw, some).tolist() == [values[i] for i in some]


@pytest.mark.parametrize("values", [[0], [0] * 500, [2**64 - 1], [0, 2**64 - 1], list(range(1000)), [5] * 70 + [2**63] * 70])
def test_elias_fano_extremes(values):
    raw = token_store.ef_encode(np.array(values, dtype=np.uint64))
    assert token_store.ef_decode(raw).tolist() == values
    with pytest.raises(IndexError):
        token_store.ef_select(raw, len(values))


def test_elias_fano_is_small():
    bounds = np.cumsum(np.random.default_rng(1).integers(1, 3000, 10_000))
    assert len(token_store.ef_encode(bounds)) < 10_000 * (3 + np.log2(1500)) / 8


def test_boundaries_take_half_of_a_plain_table_at_most(spark, sf_dir, tmp_path):
    """Against 32-bit boundaries and 64-bit ids, over a whole store."""
    path = str(tmp_path / "store")
    token_store.write_token_store(table(spark, sf_dir, "documents"), path, PATH, shards=1)
    held = token_store.read_token_store(spark, path).select("n_docs", "bounds", "docs").collect()
    n = sum(r.n_docs for r in held)
    assert sum(len(r.bounds) for r in held) <= 0.5 * 4 * n + 64 and sum(len(r.docs) for r in held) <= 0.5 * 8 * n + 64


@pytest.mark.parametrize("limits", [(40, 1 << 17), (1 << 21, 3)])
def test_segments_and_lookup(spark, docs, plain, tmp_path, monkeypatch, limits):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", limits[0])
    monkeypatch.setattr(token_store, "SEGMENT_DOCS", limits[1])
    monkeypatch.setattr(token_store, "READ_DOCS", 2)
    rows = [(i * i - 50, t) for i, t in enumerate(ODD)] + [(-50, "again"), (None, "no id"), (None, "no id"), (2**62, "far"), (-(2**62), "low")]
    path = str(tmp_path / "store")
    token_store.write_token_store(docs(rows), path, PATH, end_id=0, shards=2)
    assert token_store.read_token_store(spark, path).count() > 2  # more than the shards
    got = token_store.read_documents(spark, path, with_ids=True).collect()
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got))) == sorted(map(str, ((d, [*plain(t), 0]) for d, t in rows)))
    asked = [-50, 2**62, 7777, -49, -(2**62)]
    found = sorted((r.doc_id, r.ids) for r in token_store.lookup(spark, path, asked).collect())
    assert found == sorted((d, [*plain(t), 0]) for d, t in rows if d in asked)


def test_word_cache_stays_within_its_bound(words, plain, monkeypatch):
    """All words are alike long, and new ones come without end."""
    monkeypatch.setattr(tokens, "MAX_WORDS", 500)
    for k in range(20):
        text = " ".join(f"x{k}{i:03d}" for i in range(200))
        ids, _ = words.encode(pa.array([text]))
        assert ids.tolist() == plain(text) and len(words._key) <= 700


def test_groups_hold_all_rows_and_few_bytes():
    rows = [(i, "x" * n if n is not None else None) for i, n in enumerate([0, 5, 300, None, 40, 40, 40, 90, 1, 0, 250, 3])]
    batches = [pa.RecordBatch.from_pylist([{"i": i, "t": t} for i, t in rows[a : a + 5]], pa.schema([("i", pa.int64()), ("t", pa.string())])) for a in range(0, 12, 5)]
    groups = [g.to_pylist() for g in tokens.grouped(iter(batches), size=100)]
    assert [(r["i"], r["t"]) for g in groups for r in g] == rows
    assert all(len(g) == 1 or sum(len(r["t"] or "") for r in g) <= 100 for g in groups) and len(groups) < 8


def test_store_round_trip(spark, docs, plain, tmp_path):
    rows = [(7 * i % 101 - 3, t) for i, t in enumerate(ODD)] + [(5, "twice"), (5, "twice"), (None, "no id")]
    path = str(tmp_path / "store")
    token_store.write_token_store(docs(rows), path, PATH, end_id=0, shards=3)
    got = sorted(token_store.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    assert sorted(map(str, ((r.doc_id, r.ids) for r in got))) == sorted(map(str, ((d, [*plain(t), 0]) for d, t in rows)))
    token_store.write_token_store(docs([]), path + "0", PATH)
    assert token_store.read_documents(spark, path + "0").count() == 0


def test_whole_table_against_plain_encoding(spark, sf_dir, plain):
    from tidemark.llm.queries import op7_token_store

    start = 0
    got = {r.doc_id: r for r in op7_token_store(spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = [*plain(r.text), 0]
        assert tuple(got.pop(r.doc_id)) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def check_packing(pieces, want, capacity):
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for doc, ids in want.items():
        at = 0
        for k, p in enumerate(sorted(by_doc.pop(doc), key=lambda p: p.piece)):
            assert (p.piece, p.start, p.ids_crc32) == (k, at, zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()))
            assert p.length == capacity or k == 0
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_seq), -(-sum(map(len, want.values())) // capacity)


def test_packing_of_the_whole_table(spark, sf_dir, plain):
    from tidemark.llm.queries import op10_best_fit_packing

    want = {r.doc_id: [*plain(r.text), 2] for r in table(spark, sf_dir, "documents").collect()}
    used, least = check_packing(op10_best_fit_packing(spark, sf_dir).collect(), want, 1024)
    assert used <= 1.02 * least + 1


def test_packing_of_odd_texts(docs, plain):
    rows = list(enumerate(ODD))
    used, least = check_packing(packing.pack(docs(rows), PATH, 16, 2).collect(), {d: [*plain(t), 2] for d, t in rows}, 16)
    assert used <= least + 2
    assert packing.pack(docs([]), PATH).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_patterns_hold_every_length_once(histogram):
    patterns = packing.plan_patterns(histogram, 60)
    held = {}
    for p in patterns:
        assert p.count > 0 and sum(p.lengths) <= 60 and sum(3 * n > 60 for n in p.lengths) <= 2
        for n in p.lengths:
            held[n] = held.get(n, 0) + p.count
    assert held == histogram
    slots = packing.slot_arrays(patterns)
    places = set()
    for n, c in histogram.items():
        first, base, where = slots[n]
        k = np.searchsorted(first, np.arange(c), side="right") - 1
        for s, o in zip(base[k] + np.arange(c) - first[k], where[k], strict=True):
            places.add((int(s), int(o)))
    assert len(places) == sum(histogram.values())
