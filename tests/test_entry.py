import math

import duckdb
import pytest

import __spark_entry__ as entry
from wavelens.plans.registry import ORACLE, QUERIES
from wavelens.sources.tables import TABLES, table_path

SF = "/root/testdata/sf0.001"
NO_ORACLE_OK = set()


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 3 and {"role", "wer", "gt_wer"} <= set(df.columns)


def test_every_query_has_an_oracle():
    missing = set(QUERIES) - set(ORACLE) - NO_ORACLE_OK
    assert not missing, missing
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    sdf = entry.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    ddf = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(ddf.columns) == cols
    drows = sorted((tuple(_norm(None if (isinstance(r[c], float) and math.isnan(r[c]) and ddf[c].dtype == object)
                                else (r[c].item() if hasattr(r[c], "item") else r[c])) for c in cols)
                    for r in ddf.to_dict("records")), key=repr)
    assert srows == drows
