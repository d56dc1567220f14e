"""Queries with SQL beside them, on the smallest tables."""

import duckdb
import pytest

from wavelens.llm import queries as q
from wavelens.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    df = q.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({q.ORACLE[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want))
