import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.environment["PYTHONPATH"] = ROOT
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="session")
def same():
    def rows(frame):
        cell = lambda v: "" if str(v) in ("nan", "<NA>", "None") else str(v)
        return sorted(tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))

    def check(spark_df, duck_result):
        a, b = spark_df.toPandas(), duck_result.df()
        assert sorted(a.columns) == sorted(b.columns)
        assert rows(a) == rows(b)

    return check
