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
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def same(df, relation) -> bool:
    """Equal rows and columns, floats to nine places, in any order."""

    def cell(v):
        return round(v, 9) if isinstance(v, float) else v

    cols = [d[0] for d in relation.description]
    at = [cols.index(c) for c in sorted(cols)]
    want = sorted(repr(tuple(cell(r[i]) for i in at)) for r in relation.fetchall())
    got = sorted(repr(tuple(cell(r[c]) for c in sorted(df.columns))) for r in df.collect())
    return sorted(cols) == sorted(df.columns) and got == want
