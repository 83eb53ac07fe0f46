import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def oracle():
    """oracle(dir) is a DuckDB connection with the tables of dir as views."""
    import glob

    import duckdb

    def connect(path):
        c = duckdb.connect()
        for p in glob.glob(f"{path}/*.parquet"):
            c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
        return c

    return connect


def same(df, relation) -> bool:
    """Whether a DataFrame and a DuckDB relation have the same columns and rows."""
    cols = relation.columns
    assert sorted(cols) == sorted(df.columns), (sorted(cols), sorted(df.columns))
    rows = [tuple(r) for r in df.select(*sorted(cols)).collect()]
    order = [cols.index(c) for c in sorted(cols)]
    other = [tuple(r[k] for k in order) for r in relation.fetchall()]
    return sorted(map(repr, rows)) == sorted(map(repr, other))
