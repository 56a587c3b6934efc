"""Every query with SQL equals DuckDB on the smallest tables; every other one runs with a stable schema."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(cell, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    found = duck.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in found.description]
    rows = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    kinds = {r[0]: str(r[1]) for r in duck.execute("DESCRIBE " + catalogue.ORACLES[name]).fetchall()}
    assert {c: KINDS.get(k, kinds[c]) for c, k in df.dtypes} == {c: kinds[c] for c in df.columns}
    got = sorted(repr(tuple(cell(r[c]) for c in sorted(columns))) for r in df.collect())
    want = sorted(repr(tuple(cell(r[columns.index(c)]) for c in sorted(columns))) for r in rows)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_plans_stay_in_the_engine(spark, sf_dir):
    """Declarative operators use no Python workers, and filters and columns reach the scan."""
    for name in sorted(set(catalogue.ORACLES) - {"ledger_heads", "ledger_verify", "fixed_share", "control_loop"}):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan, name
    plan = catalogue.QUERIES["class_detection"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "PushedFilters: [IsNotNull(l_returnflag), Not(EqualTo(l_returnflag,N))]" in plan


@pytest.mark.parametrize("rows", [[], [(1, 900.0, "view"), (2, 700.0, "error"), (3, 600.0, "view"), (7, 30.0, "view"), (4, 20.0, "view"), (5, 10.0, "purchase"), (6, 9.0, "view")], [(1, 90.0, "error"), (2, None, "view"), (3, 80.0, "error")]])
def test_best_threshold_at_a_loss(spark, tmp_path, rows):
    """The best prefix counts where none pays, and an empty table has none."""
    spark.createDataFrame([(i, v, kind) for i, v, kind in rows], "event_id long, value double, event_type string").selectExpr("*", "1L AS user_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(catalogue.ORACLES["best_threshold_reward"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["best_threshold_reward"](spark, str(tmp_path)).collect()]
    assert got == want and len(got) == min(len(rows), 1)
