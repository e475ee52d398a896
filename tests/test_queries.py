"""Every registered query that SQL can express gives the rows of its SQL; the others have tests of their own."""

from __future__ import annotations

import pytest

from oracle import SF, same
from websieve.queries import QUERIES, SQL

#: Queries without SQL, and where each is compared with a brute-force version.
ELSEWHERE = {
    "fragment_text": "test_brute.py", "page_fragments": "test_brute.py", "random_pages_filter": "test_brute.py", "detected_language": "test_brute.py", "distinct_window_exact": "test_brute.py",
    "repeated_text": "test_brute.py", "consume_keywords": "test_brute.py", "link_edges_all": "test_link_edges_all.py", "ml_classify": "test_ml_classify.py",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name])


def test_the_rest_is_tested():
    assert set(QUERIES) - set(SQL) == set(ELSEWHERE)


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and got.columns == ["id"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_llm_part_may_be_missing(monkeypatch):
    """Only an import that fails because the part isn't there is passed over."""
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert __spark_entry__.queries().keys() == QUERIES.keys() and __spark_entry__.oracle_sql().keys() == SQL.keys()
