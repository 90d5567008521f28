import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from screenlens.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "screenlens-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def rows():
    def collect(df, *order):
        return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]

    return collect


@pytest.fixture(params=[1, 7])
def both_ways(request, spark, monkeypatch):
    """Run a test with everything in one partition and with every sequence cut into several."""
    monkeypatch.setattr("screenlens.operators.ordered.CHUNK_BYTES", 1 << 60 if request.param == 1 else 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)
