"""Distinct-window over a stream, with the window as bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import RecentValues


def distinct_window_stream(stream: DataFrame, value_col: str, order_col: str, n: int) -> DataFrame:
    """order_col, value of rows whose value isn't among the last n emitted ones.

    The window is one sequence, so all rows have one key; its state holds at most n values.
    Rows are taken in order_col's order within a micro-batch.
    """
    kind = stream.schema[order_col].dataType.simpleString()

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = RecentValues(n)
        for v in state.get[0] if state.exists else []:
            recent.add(v)
        out = []
        for order, value in sorted(((o, v) for b in batches for o, v in zip(b["_order"], b["_value"])), key=lambda x: x[0]):
            if value not in recent:
                recent.add(value)
                out.append((order, value))
        state.update((list(recent._queue),))
        yield pd.DataFrame(out, columns=["_order", "_value"])

    rows = stream.select(F.lit(0).alias("_all"), F.col(order_col).alias("_order"), F.coalesce(F.col(value_col).cast("string"), F.lit("")).alias("_value"))
    found = rows.groupBy("_all").applyInPandasWithState(step, f"_order {kind}, _value string", "recent array<string>", "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("_order").alias(order_col), F.col("_value").alias(value_col))
