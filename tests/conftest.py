import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from ledgerwave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """A SalesFrame from a list of (date, value) or (date, value, segment)."""
    from ledgerwave import SalesFrame

    def make(rows, freq="D", segment=None, unique=True, keys=()):
        names = ["ds", "y", *([segment] if segment else []), *keys]
        types = ["date", "double", *(["string"] if segment else []), *["string" for _ in keys]]
        schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
        df = spark.createDataFrame(rows, schema).selectExpr("*", "y IS NULL AS is_gap")
        return SalesFrame(df, freq, tuple(keys), segment, one_row_per_date=unique)

    return make
