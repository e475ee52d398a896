"""Order-dependent operators: windows over emitted values, suppression, ranks and samples."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTEXT_SIZE, TEXT_MARGIN, REGEX_MARGIN = 1000, 20, 40


class RecentValues:
    """Membership among the last ``capacity`` values added.

    Adding at capacity forgets the oldest value, also if a newer copy of it is queued.
    """

    def __init__(self, capacity: int):
        self.capacity, self._queue, self._known = capacity, deque(), set()

    def __contains__(self, value) -> bool:
        return value in self._known

    def __len__(self) -> int:
        return len(self._queue)

    def add(self, value):
        """Add a value; returns the one that had to go, if any."""
        gone = None
        if len(self._queue) >= self.capacity:
            gone = self._queue.popleft()
            self._known.discard(gone)
        self._queue.append(value)
        self._known.add(value)
        return gone


def _in_order(df: DataFrame, value: Column, order_col: str, keep: Callable[[], Callable[[object], bool]], exclude: bool) -> DataFrame:
    """Rows whose value keep() accepts, asked in order.

    The memory is one sequence over all rows, so one task has to see them; only the order and
    the value go through it, a batch at a time, and the rows themselves are picked by a semi join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepts = keep()
        for batch in batches:
            mask = pa.array([accepts(tuple(v.items()) if isinstance(v, dict) else v) != exclude for v in batch.column(1).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask)], [order_col])

    thin = df.select(F.col(order_col), value.alias("value")).repartition(1).sortWithinPartitions(order_col)
    kind = df.schema[order_col].dataType.simpleString()
    return df.join(thin.mapInArrow(run, f"`{order_col}` {kind}"), order_col, "left_semi")


def first_per_value(df: DataFrame, value: Column, order_col: str) -> DataFrame:
    """The first row of each value; minima are combined before the shuffle, so no value is hot."""
    first = df.select(value.alias("value"), order_col).groupBy("value").agg(F.min(order_col).alias(order_col)).select(order_col)
    return df.join(first, order_col, "left_semi")


def distinct_window(df: DataFrame, value: Column, n: int, order_col: str = "seq", *, exclude: bool = False) -> DataFrame:
    """Rows whose value isn't among the last n emitted ones (or, excluding, is).

    With at most n distinct values nothing is ever forgotten, and that is the first row of
    each value, found without any single task. order_col must be unique.
    """
    values = df.select(value.alias("value")).distinct().limit(n + 1).count()
    if values <= n and not exclude:
        return first_per_value(df, value, order_col)

    def fresh():
        recent = RecentValues(n)

        def accepts(v) -> bool:
            if v in recent:
                return False
            recent.add(v)
            return True

        return accepts

    return _in_order(df, value, order_col, fresh, exclude)


def context_of(leaf) -> Column:
    """The characters around a text or regex match, which stand for the fragment it is in."""
    text = F.coalesce(F.col("eval_text"), F.lit(""))
    if leaf.name == "regex":
        found = F.regexp_extract(text, leaf.arg, 0)
        at, size, margin = F.instr(text, found), F.length(found), REGEX_MARGIN
    else:
        at, size, margin = F.instr(F.lower(text), F.lit(leaf.arg.lower())), F.lit(len(leaf.arg)), TEXT_MARGIN
    start = F.greatest(at - margin, F.lit(1))
    return text.substr(start, at + size + margin - start)


def suppress_repeats(df: DataFrame, leaf, order_col: str = "seq", n: int = CONTEXT_SIZE) -> DataFrame:
    """Rows whose match stands in a context not among the last n seen, passing or not."""

    def fresh():
        recent = RecentValues(n)

        def accepts(v) -> bool:
            known = v in recent
            recent.add(v)
            return not known

        return accepts

    return _in_order(df, context_of(leaf), order_col, fresh, False)


def recent_distinct(df: DataFrame, value: Column, order_col: str, n: int | None = None) -> DataFrame:
    """Link, address and keyword dedup: rows whose value isn't among the last n new ones, or among all without n."""
    return first_per_value(df, value, order_col) if n is None else distinct_window(df, value, n, order_col)


def chunks(df: DataFrame, key: str, order_col: str, size: int = 2000) -> DataFrame:
    """Number each key's rows in order and cut them into chunks of ``size``."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order_col)) - 1
    return df.withColumn("chunk_sequence", rank).withColumn("chunk", F.floor(F.col("chunk_sequence") / size))


def balanced_sample(df: DataFrame, category: str, order: Column, k: int | None = None, minimum: int = 0) -> DataFrame:
    """At most k rows of each category (the least by ``order``), without too small categories.

    k defaults to the size of the smallest category that stays.
    """
    sizes = df.groupBy(category).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > minimum)
    least = sizes.agg(F.min("n")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return df.join(F.broadcast(sizes.select(category)) if sizes.count() <= 10_000 else sizes.select(category), category, "left_semi").withColumn("_rank", rank).where(F.col("_rank") <= (k or least)).drop("_rank")
