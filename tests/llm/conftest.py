from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Rows (doc_id, text) → documents frame, with odd extra columns."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("uid", T.StringType()),
                           T.StructField("score", T.IntegerType())])

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "u", 1) for i, t in rows], schema)

    return make
