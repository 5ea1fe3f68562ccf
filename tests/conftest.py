import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


BAR = "ticker string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, sector string, industry string"


def bar_rows(ticker="TEST", n=300, seed=42, vol=0.01, base=100.0, sector="Technology", industry="Software"):
    rng = np.random.default_rng(seed)
    close = base * np.exp(np.cumsum(rng.normal(0, vol, n)))
    volume = rng.uniform(1e6, 1e7, n)
    day = dt.datetime(2024, 1, 1)
    return [(ticker, day + dt.timedelta(days=i), 0.99 * c, 1.02 * c, 0.98 * c, float(c), float(v), sector, industry) for i, (c, v) in enumerate(zip(close.tolist(), volume.tolist(), strict=True))]


@pytest.fixture(scope="session")
def single(spark):
    return spark.createDataFrame(bar_rows(), BAR).cache()


@pytest.fixture(scope="session")
def multi(spark):
    return spark.createDataFrame(bar_rows("AAA") + bar_rows("BBB", seed=99, vol=0.015, base=50.0, sector="Healthcare", industry="Biotech"), BAR).cache()
