import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Runs SQL over a folder's tables; rows as sorted tuples of columns in the order of their names."""
    import duckdb

    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

    def run(sql: str, folder: str):
        con = duckdb.connect()
        con.sql("set TimeZone='UTC'")
        for t in tables:
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        found = con.sql(sql)
        order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
        return sorted(found.columns), sorted(tuple(plain(row[i]) for i in order) for row in found.fetchall())

    return run


def plain(value):
    if isinstance(value, float):
        return repr(int(value) if value == int(value) else round(value, 9))
    return repr(value)


@pytest.fixture(scope="session")
def same(duck):
    def check(df, sql: str, folder: str) -> int:
        columns = sorted(df.columns)
        mine = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
        names, theirs = duck(sql, folder)
        assert columns == names
        assert mine == theirs
        return len(mine)

    return check
