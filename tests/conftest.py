import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
#: For Spark's Python workers, wherever the tests are started.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("local")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    """DuckDB with the given tables as views."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return c


def plain(rows):
    """Rows as sorted tuples that compare alike whichever engine they come from."""

    def one(v):
        if v is None or str(v) in ("NaT", "<NA>") or v != v:
            return "~"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return round(float(v), 6)
        return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "year") else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


def same(spark_df, duck_df):
    a, b = spark_df.toPandas(), duck_df.df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    left, right = plain(a[cols].itertuples(index=False)), plain(b[cols].itertuples(index=False))
    assert left == right
    return left
