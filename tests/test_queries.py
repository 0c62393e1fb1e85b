"""Every registered query on the smallest tables, against its SQL in DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.check import rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


# the type each column must have in both engines
KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean",
         "INTEGER": "int"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert rows
        return
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert dict(df.dtypes) == {c: KINDS[str(t)] for c, t in zip(cols, (d[1] for d in cur.description))}
    assert rows_of(df.columns, rows) == rows_of(cols, cur.fetchall())


def test_entry(spark):
    assert entry(spark).columns == ["rankic", "icir", "n_dates"]
    assert entry(spark).first()["n_dates"] == 81


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
