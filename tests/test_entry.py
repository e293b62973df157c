import duckdb

import __spark_entry__ as entry
from claimforge import queries


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.SQL) <= set(queries.QUERIES)


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and len({r["cluster_id"] for r in rows}) == len(rows)


def test_sql_says_the_same(spark):
    """A few whole comparisons; the driver makes them all."""
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "events", "pages", "part", "supplier"):
        con.sql(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    for name in ("norm_url_link", "norm_date_ym", "cluster_assignment", "canonical_profile"):
        got = entry.queries()[name](spark, path).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        both = [sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None))) for df in (got, want)]
        assert both[0] == both[1], name
