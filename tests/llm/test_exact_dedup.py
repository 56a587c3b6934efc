import hashlib

from tidemark.llm.exact_dedup import drop_exact_duplicates, duplicate_groups

ROWS = [(1, "Same TEXT"), (2, "same text"), (3, "same  text"), (4, None), (5, ""), (6, "ÄB"), (7, "äb"), (8, "äB"), (9, "Äb"), (9, "Äb"), (None, "x"), (10, "X")]


def test_groups_against_brute_force(docs):
    got = {(r.doc_id, r.text_sha256): r for r in duplicate_groups(docs(ROWS), keep="max").collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for doc, text in ROWS:
        t = (text or "").translate(low)
        same = [d for d, x in ROWS if (x or "").translate(low) == t]
        r = got[(doc, hashlib.sha256(t.encode()).hexdigest())]
        keep = max(d for d in same if d is not None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(same), doc == keep)


def test_keep_smallest_and_empty_table(docs):
    assert {r.doc_id for r in duplicate_groups(docs(ROWS)).where("kept").collect()} == {1, 3, 4, 6, 7, 10}
    assert duplicate_groups(docs([])).count() == 0


def test_filter_keeps_one_row_of_each_group_with_all_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, 2), (1, "A", 1, 2), (2, "a", 3, 4), (3, None, 5, 6)], "doc_id long, text string, _xd_size int, kept int")
    out = drop_exact_duplicates(df, keep="max")
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.kept) for r in out.collect()) == [(2, 4), (3, 6)]
    assert sorted(r.doc_id for r in drop_exact_duplicates(df, keep="min").collect()) == [1, 3]
    assert drop_exact_duplicates(df.limit(0)).count() == 0


def test_work_columns_do_not_touch_the_callers(spark):
    df = spark.createDataFrame([(1, "a", "x", "y", "z"), (2, "A", "x", "y", "z")], ["doc_id", "text", "_xd_text", "_XD_HASH", "_xd_keep"])
    assert [tuple(r) for r in drop_exact_duplicates(df).collect()] == [(1, "a", "x", "y", "z")]
    odd = df.select(df["doc_id"].alias("_xd_text"), df["text"].alias("_xd_id"))
    assert sorted(tuple(r)[:4] for r in duplicate_groups(odd, "_xd_text", "_xd_id").collect()) == [(1, 1, 2, True), (2, 1, 2, False)]


def test_no_python_on_the_executors(docs):
    for df in (duplicate_groups(docs(ROWS)), drop_exact_duplicates(docs(ROWS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
