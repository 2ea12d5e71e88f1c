import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = str(tmp_path_factory.mktemp("spark"))
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{root}/shared").config("spark.sql.warehouse.dir", f"{root}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows_of(frame, columns):
    """Rows as comparable text, in any order; numbers without regard to how pandas holds nulls."""

    def plain(v):
        if v is None or v != v:
            return "null"
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
            v = int(v)
        return repr(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())


@pytest.fixture(scope="session")
def same():
    def check(result, wanted):
        assert sorted(result.columns) == sorted(wanted.columns)
        columns = sorted(wanted.columns)
        assert rows_of(result, columns) == rows_of(wanted, columns)

    return check
