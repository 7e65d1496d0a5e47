import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quillspark import session

    return session.build("local[4]", shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Holds a query's rows against its DuckDB twin's."""

    def check(name):
        import __spark_entry__

        df = __spark_entry__.queries()[name](spark, sf_dir)
        cols = sorted(df.columns)
        shown = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
        got = sorted(tuple(map(shown, r)) for r in df.select(*cols).collect())
        res = duck.execute(__spark_entry__.oracle_sql()[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        want = sorted(tuple(shown(row[names.index(c)]) for c in cols) for row in res.fetchall())
        assert got == want

    return check
