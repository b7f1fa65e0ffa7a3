from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, {extra} string"


@pytest.fixture(scope="session")
def make_docs(spark: SparkSession):
    """Documents from (doc_id, text[, source[, lang]]), with an extra column whose name may clash."""

    def make(rows, extra: str = "note") -> DataFrame:
        full = []
        for row in rows:
            doc_id, text, source, lang = (*row, *(None,) * (4 - len(row)))
            full.append((doc_id, text, lang, source, len(text) if text is not None else None, "x"))
        return spark.createDataFrame(full, DOCUMENTS.format(extra=extra)).repartition(3)

    return make
