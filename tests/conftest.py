import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from quarrylane.session import local_session

    session = local_session(8, "6g", "tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the test tables as views."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    """Values of either engine in one form."""
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def table_of(columns, rows):
    names = sorted(columns)
    at = [columns.index(c) for c in names]
    return names, sorted((tuple(str(plain(r[i])) for i in at) for r in rows))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL."""

    def check(query, sql):
        df = query(spark, DATA)
        got = table_of(df.columns, [tuple(r) for r in df.collect()])
        done = duck.execute(sql)
        want = table_of([d[0] for d in done.description], done.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
