import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from hunkline.session import get_session

    s = get_session("local[*]", 8, app_name="hunkline-tests")
    yield s
    s.stop()


def one(spark, expr_col, value, schema="x STRING"):
    """Evaluate a Column expression on a one-row DataFrame holding ``value``."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(expr_col.alias("r")).first()["r"]
