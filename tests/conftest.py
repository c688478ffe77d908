import os
import pathlib
import sys

import duckdb
import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoint')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    """Asserts that a query gives the rows of its SQL, whatever their order."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        got = sorted((tuple(_plain(r[c]) for c in names) for r in df.collect()), key=repr)
        found = duck.execute(sql)
        own = [d[0] for d in found.description]
        assert sorted(own) == names
        want = sorted((tuple(_plain(r[own.index(c)]) for c in names) for r in found.fetchall()), key=repr)
        assert got == want

    return check
