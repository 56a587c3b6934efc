"""Queries see every row of their tables: a size up from `test_queries`, and fixtures for what the tables lack."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import cell

from tidemark.functions import scalar as sc
from tidemark.operators import governance as gv
from tidemark.operators import inference as nf
from tidemark.plans import catalogue

SF = "/root/testdata/sf0.01"


def by_sql(name, folder=SF):
    """Rows of the query's SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in ("orders", "events", "supplier", "lineitem", "part", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    return sorted(repr(tuple(cell(r[names.index(c)]) for c in sorted(names))) for r in found.fetchall())


def rows(df):
    return sorted(repr(tuple(cell(r[c]) for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("n", [1, 2, 1024, 1025, 3000])
def test_one_merkle_root_a_group(spark, n):
    leaves = spark.range(n).select(F.lit("g").alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    (root,) = gv.merkle_levels(leaves, "g", "id", "h").collect()
    assert root["root"] == gv.merkle_root([hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)])


@pytest.mark.parametrize("name", ["merkle_roots", "ledger_heads", "ledger_verify", "online_pvalues", "port_services", "lateral_chains", "crowding_distance", "interaction_h", "neyman_pearson", "knn_shapley"])
def test_equals_sql_on_whole_tables(spark, name):
    assert rows(catalogue.QUERIES[name](spark, SF)) == by_sql(name)


def test_port_services(spark, tmp_path):
    """Every port counts, those of the service table above 100 too."""
    ports = [*sc.SERVICES, 99, 100, 999, 9999]
    base = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    base.withColumn("l_suppkey", F.array(*map(F.lit, ports))[(F.col("l_orderkey") % len(ports)).cast("int")].cast("long")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["l_suppkey"]: r["service"] for r in catalogue.QUERIES["port_services"](spark, str(tmp_path)).collect()}
    assert got == {p: sc.SERVICES.get(p, sc.OTHER_SERVICE) for p in ports}


def test_knn_shapley(spark):
    """Each embedding has a value."""
    got = catalogue.QUERIES["knn_shapley"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_neyman_pearson(spark, tmp_path):
    """The admissible count is that of the benign rows there are; too few of them admit no threshold."""
    con = duckdb.connect()
    benign = f"(SELECT (round(l_discount * 100) * 10 + round(l_tax * 100)) / 108::DOUBLE AS score FROM '{SF}/lineitem.parquet' WHERE l_returnflag <> 'R')"
    ((n,),) = con.execute(f"SELECT count(*) FROM {benign}").fetchall()
    m = nf.np_admissible_count(n, 0.05, 0.1)
    want = con.execute(f"SELECT round(score, 6) FROM {benign} ORDER BY score DESC LIMIT 1 OFFSET {m}").fetchone()[0]
    got = catalogue.QUERIES["neyman_pearson"](spark, SF).first()["threshold"]
    assert got == want < 1
    fpr = con.execute(f"SELECT avg((round(score, 6) > {got})::INT) FROM {benign}").fetchone()[0]
    assert 0.04 < fpr <= 0.05
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").where("l_returnflag <> 'R'").limit(5).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert catalogue.QUERIES["neyman_pearson"](spark, str(tmp_path)).first()["threshold"] == float("inf")


def test_pca_residual(spark, tmp_path):
    """Each component counts: an outlier in the last one stands out, and scores are those of numpy."""
    x = np.random.default_rng(3).normal(size=(300, 64)) * np.r_[[9.0, 8.0, 7.0, 6.0], np.ones(60)]
    x[17, 63] += 40
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: r["score"] for r in catalogue.QUERIES["pca_residual"](spark, str(tmp_path)).collect()}
    gap = x - x.mean(axis=0)
    basis = np.linalg.svd(gap, full_matrices=False)[2][:4]
    want = np.linalg.norm(gap - gap @ basis.T @ basis, axis=1)
    assert max(got, key=got.get) == 17 and np.allclose([got[i] for i in range(300)], want, atol=1e-5)
