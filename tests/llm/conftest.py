from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A maker of documents tables from (id, text) pairs; with columns whose names clash with the operators' own."""

    def make(rows, **more):
        schema = T._parse_datatype_string(DOCUMENT) if hasattr(T, "_parse_datatype_string") else DOCUMENT
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)
        for name, value in more.items():
            df = df.withColumn(name, value)
        return df

    return make
