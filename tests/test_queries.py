"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from isopleth.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(frame, columns):
    clean = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) == "NaT" else str(v)
    return sorted(tuple(clean(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, small, duck, name):
    got, want = catalogue.QUERIES[name](spark, small).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    assert not entry.entry(spark).isEmpty()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_monthly_queries_over_all_rows(spark, small, duck):
    last = duck.sql("SELECT max(date_trunc('month', l_shipdate))::timestamp FROM lineitem").limit(1).fetchall()[0][0]
    assert catalogue.QUERIES["preprocess_full_whole"](spark, small).selectExpr("max(time)").first()[0] == last


def test_anchor_years_come_from_the_tables(spark, tmp_path):
    from isopleth.sources import tables

    for name, column, value, days in (("lineitem", "l_shipdate", "l_extendedprice", ("2010-02-01", "2012-11-30")), ("orders", "o_orderdate", "o_totalprice", ("2010-04-02", "2013-05-01"))):
        spark.sql(f"SELECT 7 AS l_partkey, 10D AS {value}, explode(sequence(timestamp_ntz'{days[0]}', timestamp_ntz'{days[1]}', interval 1 day)) AS {column}").write.parquet(f"{tmp_path}/{name}.parquet")
    assert tables.anchor_years(spark, str(tmp_path)) == (2011, 2012)
    for rows in (tables.precursor, tables.target):
        assert {r[0] for r in rows(spark, str(tmp_path)).select("anchor_year").distinct().collect()} == {2011, 2012}
