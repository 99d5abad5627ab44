import duckdb
import pandas as pd
import pytest

from attesta.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"
QUERIES = {**catalogue.QUERIES, **fixtures.QUERIES}
ORACLES = {**catalogue.ORACLES, **fixtures.ORACLES}
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    def one(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return str(int(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["citation_rate", "citation_anywhere", "norm_text"])
def test_citations_hold_no_texts_in_python(spark, name):
    """Python workers would hold batches of pages: their memory grows with the tables."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "InPandas", "InArrow", "_wide("))


def test_closest_line_is_a_hint(spark):
    got = {r.quote: r.closest for r in QUERIES["fx_closest_line"](spark, SF).collect()}
    assert got["tokens T string"].startswith("a token")


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["source", "numerator", "denominator", "value"]
