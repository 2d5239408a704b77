"""Every query of the engine with SQL returns the rows of its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sparkbands import queries

DIR = "/root/testdata/sf0.001"
TABLES = ("nation", "supplier", "customer", "orders", "lineitem", "events", "embeddings")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 6) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, name):
    df, sql = queries.QUERIES[name](spark, DIR), duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(sql.fetchall(), sql.columns)


def test_beagle_and_matrix_round_trip(spark, tmp_path):
    from sparkbands.sources import text

    (tmp_path / "b").write_text("marker\tallele1\tallele2\tA\tA\tA\tB\tB\tB\nm1\t0\t1\t0.1\t0.2\t0.7\tnan\t1\t0\nbad\t0\n")
    rows, dropped = text.read_beagle(spark, str(tmp_path / "b"))
    got = {(r.marker, r.sample_id): round(r.dosage, 9) for r in rows.collect()}
    assert got == {("m1", "A"): 1.6, ("m1", "B"): 1.0} and dropped.first().n_dropped == 1
    (tmp_path / "d").write_text("marker\ts1\ts2\nc_x_10\t0.5\tNA\nc:20\t1\t2\nnone\t1\t1\n")
    rows, dropped = text.read_dosage_matrix(spark, str(tmp_path / "d"))
    got = {(r.chrom, r.pos_bp, r.sample_id): r.dosage for r in rows.collect()}
    assert dropped.first().n_dropped == 1 and text.read_dosage_matrix(spark, str(tmp_path / "d"), "c")[0].count() == 2
    assert got == {("c_x", 10, "s1"): 0.5, ("c_x", 10, "s2"): None, ("c", 20, "s1"): 1.0, ("c", 20, "s2"): 2.0}


def test_entry_without_the_subpackage(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "sparkbands.llm", None)
    monkeypatch.delitem(sys.modules, "sparkbands.llm.queries", raising=False)
    import __spark_entry__

    assert "regime_pipeline" in __spark_entry__.queries()
    assert not any(k.startswith("op") and k[2].isdigit() for k in __spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0


def test_chi_square_tail(spark):
    from pyspark.sql import functions as F

    from sparkbands.functions.tails import chi_square_tail

    # 5 % points of 1 to 6 degrees of freedom
    points = [(1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (5, 11.070498), (6, 12.591587)]
    got = spark.createDataFrame(points, "df int, x double").select(chi_square_tail(F.col("x"), F.col("df")).alias("p")).collect()
    assert all(abs(r.p - 0.05) < 1e-6 for r in got)
