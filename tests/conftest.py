import glob
import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = os.environ.get("TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Run SQL on the tables of a scale factor, or on given pandas frames instead of some."""

    def run(sql, sf="sf0.001", **frames):
        con = duckdb.connect()
        for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
            name = os.path.basename(path)[:-8]
            if name not in frames:
                con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
        for name, frame in frames.items():
            con.register(name, frame)
        return con.execute(sql).df()

    return run


@pytest.fixture(scope="session")
def same():
    """Equal rows in any order, with equal column names."""

    def check(a, b):
        a, b = a[sorted(a.columns)], b[sorted(b.columns)]
        assert list(a.columns) == list(b.columns)
        assert len(a) == len(b)
        text = lambda f: sorted("|".join(_cell(v) for v in row) for row in f.itertuples(index=False))
        assert text(a) == text(b)

    return check


def _cell(v):
    import pandas as pd

    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f":
        return str(int(v)) if float(v).is_integer() else repr(float(v))  # pandas makes nullable whole numbers floats
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind == "b":
        return str(bool(v))
    return str(int(v)) if hasattr(v, "dtype") and v.dtype.kind in "iu" else str(v)


@pytest.fixture(scope="session")
def data():
    return DATA
