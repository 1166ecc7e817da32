import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lettermill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate columns over one row."""
    def evaluate(column, **values):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()) or [F.lit(1).alias("x")])
        return row.select(column.alias("out")).first()["out"]

    return evaluate
