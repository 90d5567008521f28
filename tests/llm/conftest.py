import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with more columns whose names clash with ours."""

    def make(pairs):
        df = spark.createDataFrame(list(pairs), "doc_id bigint, text string")
        for name in ("hash", "key", "pos", "line", "shard", "block", "score", "length", "component_id", "fp"):
            df = df.withColumn(name, F.lit(name))
        return df

    return make
