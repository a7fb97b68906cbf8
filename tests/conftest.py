import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from foldline.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf():
    return SMALL


@pytest.fixture(scope="session")
def one(spark):
    """The value of a column expression built by ``make()`` over one row of columns."""
    from pyspark.sql import functions as F

    def value(make, **columns):
        row = spark.range(1).select(*[F.lit(v).alias(n) if not isinstance(v, (list, tuple)) else F.array(*[F.lit(x) for x in v]).alias(n)
                                      for n, v in columns.items()])
        return row.select(make().alias("x")).first()["x"]

    return value
