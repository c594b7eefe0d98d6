import pytest
from pyspark.sql import functions as F

from tests.local import session
from tidemark.plans.views import Tables
from tidemark.session import settle

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("4")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SMALL)


@pytest.fixture(scope="session")
def hot(spark):
    """Two symbols, one of them holding almost all rows: a seeded walk with ties and gaps."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("HOT", 700), ("COLD", 40)):
        close = np.round(100 + rng.normal(0, 1, n).cumsum(), 2)
        spread = np.abs(rng.normal(0, 0.5, n)).round(2)
        frames.append(pd.DataFrame({
            "symbol": symbol, "rn": np.arange(1, n + 1, dtype="int64"), "time": pd.date_range("2024-01-01", periods=n, freq="h"), "open": close - 0.1,
            "high": close + spread, "low": close - spread, "close": close, "tick_volume": rng.integers(1, 50, n), "spread": 2.0,
        }))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("time", F.col("time").cast("timestamp_ntz"))
    return pdf, settle(df)
