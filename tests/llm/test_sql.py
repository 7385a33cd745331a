"""The text operators' queries against their SQL."""

import os

import duckdb
import pytest

from kinelake.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("documents", "pages", "benchmark", "clicks"):
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    cur = con.execute(SQL[name])
    columns = [c[0] for c in cur.description]
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    plain = lambda rows: sorted(tuple(f"{v + 0.0:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plain(got) == plain(cur.fetchall())
