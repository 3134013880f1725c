import math

import duckdb
import pytest

from textloom.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    session.stop()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return str([norm(x) for x in value])
    return str(value)


@pytest.fixture(scope="session")
def agrees(spark):
    """Asserts that a query and its oracle have the same rows over a folder of tables."""

    def check(query, sql, sf="/root/testdata/sf0.001"):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        df = query(spark, sf)
        cols = sorted(df.columns)
        rel = con.execute(sql)
        names = [c[0] for c in rel.description]
        assert sorted(names) == cols
        theirs = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
        assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == theirs

    return check
