"""Every registered query of the artifact engine against its SQL."""

from collections import Counter

import duckdb
import pytest

from quarry import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(queries.ORACLES[name])
    assert cols == sorted(want.columns)
    assert Counter(map(tuple, df.select(*cols).collect())) == Counter(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry_is_a_dataframe(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
