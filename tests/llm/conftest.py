from __future__ import annotations

import pytest


@pytest.fixture
def docs(spark):
    """Rows with nulls, empty and repeated texts, clashing extra columns and a long text."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", -1, "k") for i, t in rows], "doc_id bigint, text string, kept string, keep_id int, key string")

    return make
