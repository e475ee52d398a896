"""Queries of this subpackage against their SQL, over whole small tables."""

from __future__ import annotations

import pytest

from oracle import SF, same
from websieve.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name])
