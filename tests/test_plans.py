import pandas as pd
import pytest

import __spark_entry__ as entry
from factloom import registry
from factloom.sources import schemas

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(df):
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = entry.queries()[name](spark, SF)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got = canon(result.toPandas())
    if name in registry.SQL:
        assert got == canon(duck.sql(registry.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_schemas(spark):
    for name in schemas.TABLES:
        assert schemas.empty(spark, name).count() == 0
    dup = spark.createDataFrame([(1, "a", "b", "c"), (1, "x", "y", "z")], schemas.TABLES["sics"][0])
    assert schemas.violations(dup, "sics").count() == 1
