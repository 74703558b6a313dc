import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query's rows against its SQL's, in any order."""

    def norm(frame, names):
        def cell(v):
            if v is None or v != v:
                return None
            return round(float(v), 9) if hasattr(v, "__float__") and not isinstance(v, str | bool) else v

        return sorted(tuple(str(cell(v)) for v in row) for row in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False))

    def check(query, sql):
        got, want = query(spark, DATA).toPandas(), duck.sql(sql).df()
        names = sorted(got.columns)
        assert names == sorted(want.columns)
        assert norm(got, names) == norm(want, names)

    return check
