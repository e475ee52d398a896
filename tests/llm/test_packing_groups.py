"""Groups of the packing operator stay bounded whatever the ids are."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from websieve.llm.packing import pack


@pytest.mark.parametrize("one_id", ["null", "7"])
def test_rows_of_one_id_spread_over_groups(spark, one_id):
    df = spark.range(3000).select(F.expr(f"if(id % 3 < 2, {one_id}, id)").alias("doc_id"), (F.col("id") % 90 + 10).alias("n"))
    got = pack(df, df["n"], capacities=(100, 200), overhead=1, group_pieces=100).collect()
    sizes = Counter(r.bin_id.split("-")[0] for r in got)
    assert len(got) == 3000 and sum(r.length for r in got) == sum(i % 90 + 10 for i in range(3000))
    assert len(sizes) == 30 and max(sizes.values()) < 200
