import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def lines(spark):
    """Frame of ``path, line_number, value`` from a list of texts."""

    def make(values, path="a.log"):
        rows = [(path, i, v) for i, v in enumerate(values, start=1)]
        return spark.createDataFrame(
            rows, "path string, line_number bigint, value string"
        )

    return make


@pytest.fixture
def column_of(lines):
    """Results of a column function for a list of texts, in their order."""

    def evaluate(values, column):
        frame = lines(values).select("line_number", column.alias("r"))
        return [r.r for r in sorted(frame.collect())]

    return evaluate
