import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):  # tests only: no shared folder is configured
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="hourcast-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def hourly_fixture(spark):
    """100 hourly rows from 2023-01-01 (seeded here), rain every 10th hour."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    n = 100
    pdf = pd.DataFrame({
        "datetime": pd.date_range("2023-01-01", periods=n, freq="h"),
        "trip_count": rng.integers(10, 100, n).astype("int64"),
        "temp": rng.uniform(0, 30, n),
        "humidity": rng.uniform(30, 90, n),
        "wind_speed": rng.uniform(0, 20, n),
        "rain_1h": [float(rng.uniform(1, 10)) if i % 10 == 0 else 0.0 for i in range(n)],
        "weather_main": rng.choice(["Clear", "Clouds", "Rain"], n),
    })
    return pdf
