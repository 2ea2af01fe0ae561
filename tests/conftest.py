import os
import sys
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.codegen.wholeStage", "false")  # small tables: compiling takes longer than running
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def series(spark):
    """Long returns from percent values, dated daily from 2000-01-30."""

    def make(values, f=None, start=date(2000, 1, 30), days=None):
        dates = days or [start + timedelta(i) for i in range(len(values))]
        rows = [(0, d, None if v is None else v / 100.0, None if f is None or f[i] is None else f[i] / 100.0) for i, (d, v) in enumerate(zip(dates, values, strict=True))]
        return spark.createDataFrame(rows, "sid int, dt date, ret double, f double")

    return make
