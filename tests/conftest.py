import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data(spark):
    """Forty rows of seven columns with numpy copies, as regression and as classes."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 7))
    y = x @ np.array([1.0, -2.0, 0.5, 0.0, 3.0, 0.0, 1.0]) + 0.3 * rng.normal(size=40)
    s = np.where(y + rng.normal(size=40) > 0, 1.0, -1.0)
    schema = "row_id bigint, y double, features array<double>"
    reg = spark.createDataFrame([(i, float(y[i]), x[i].tolist()) for i in range(40)], schema)
    cls = spark.createDataFrame([(i, float(s[i]), x[i].tolist()) for i in range(40)], schema)
    return {"x": x, "y": y, "s": s, "reg": reg.repartition(3).cache(),
            "cls": cls.repartition(3).cache()}
