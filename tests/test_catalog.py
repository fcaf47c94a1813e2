"""Every query with an oracle gives DuckDB's rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql()[name]
    cols = sorted(df.columns)
    assert sorted(duck.sql(sql).columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert plain(map(tuple, df.select(*cols).collect())) == plain(duck.sql(f"select {quoted} from ({sql})").fetchall())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["package", "from_version", "to_version", "total_diff_lines", "risk_score", "severity"]
    assert df.count() > 0
