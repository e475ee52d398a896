"""Pandas UDFs that are made when used, as their types need a running session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def columnar(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    def wrap(fn: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            return F.pandas_udf(fn, kind)(*columns)

        call.__doc__ = fn.__doc__
        return call

    return wrap
