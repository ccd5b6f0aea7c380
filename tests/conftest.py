from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for the Python workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    if not Path(SF).exists():
        pytest.skip("no test data here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(value):
    """A value that compares alike from either engine."""
    import math

    if value is None or isinstance(value, float) and math.isnan(value):
        return "None"
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="session")
def same_rows(spark, duck, sf):
    """Compares a query with its SQL."""

    def check(query, sql):
        frame = query(spark, sf)
        names = sorted(frame.columns)
        mine = sorted(tuple(plain(r[n]) for n in names) for r in frame.collect())
        relation = duck.sql(sql)
        assert sorted(relation.columns) == names
        at = [relation.columns.index(n) for n in names]
        assert mine == sorted(tuple(plain(r[i]) for i in at) for r in relation.fetchall())

    return check
