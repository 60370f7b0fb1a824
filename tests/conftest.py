import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for Python workers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(value):
    """A value in a form that compares across engines."""
    if isinstance(value, float):
        return int(value) if value == int(value) and abs(value) < 1e15 else round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())


def rows_of_sql(duck, sql):
    rel = duck.sql(sql)
    cols = list(rel.columns)
    order = [cols.index(c) for c in sorted(cols)]
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rel.fetchall())
