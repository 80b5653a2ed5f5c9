"""Fixtures of the operators' tests."""

import pytest


@pytest.fixture
def docs_of(spark):
    """documents with clashing further columns, from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        rows = [(*r, None, None)[:4] for r in rows]
        return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, keep_id string, size int")

    return make
