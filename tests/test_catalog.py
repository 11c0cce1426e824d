"""Every query against its oracle SQL on the smallest tables, and the sequential ones against plain Python."""

import duckdb
import pandas as pd
import pytest

from kinetra.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list:
    def value(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return "~"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_its_sql(spark, duck, name):
    got, expected = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """events with values that are zero, negative, null, NaN and infinite."""
    folder = str(tmp_path_factory.mktemp("odd"))
    c = duckdb.connect()
    values = "[0.0, -0.0, -3.5, NULL, 'nan', 'inf', '-inf', 1e-300, 2.5, 90.0, -90.0]"
    c.sql(f"copy (select event_id, ts, user_id, CASE WHEN event_id % 5 = 0 THEN event_type ELSE 'error' END AS event_type, CAST({values} AS DOUBLE[])[event_id % 11 + 1] AS value, props from '{SF}/events.parquet') to '{folder}/events.parquet'")
    c.sql(f"create view events as select * from '{folder}/events.parquet'")
    return c, folder


@pytest.mark.parametrize("name", ["x23_source_selection", "p4_p6_p7_predicates"])
def test_odd_values_match_the_sql(spark, odd, name):
    c, folder = odd
    assert plain(catalog.QUERIES[name](spark, folder).toPandas()) == plain(c.sql(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", ["g1_balanced_group_folds", "g2_deficit_split"])
@pytest.mark.parametrize("customers", [0, 1, 2, 4])
def test_splits_of_few_groups_match_the_sql(spark, tmp_path, name, customers):
    c = duckdb.connect()
    c.sql(f"copy (select * replace (CASE WHEN o_custkey % {customers} > 0 THEN o_custkey % {customers} END AS o_custkey) from '{SF}/orders.parquet' where {customers} > 0) to '{tmp_path}/orders.parquet'")
    c.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    assert plain(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == plain(c.sql(catalog.ORACLE_SQL[name]).df())
