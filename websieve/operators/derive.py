"""Derived page columns, added only for queries that look at them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.html import fragments_of
from ..functions.language import detect_language
from .classify import with_prediction
from .filters import model_name
from .geo import with_geo


def with_needs(df: DataFrame, needs: set[str], leaves, ctx) -> DataFrame:
    if "fragments" in needs and "fragments" not in df.columns:
        df = df.withColumn("fragments", fragments_of(F.col("data")))
    if "lang" in needs and "lang" not in df.columns:
        df = df.withColumn("lang", detect_language(F.col("eval_text")))
    if "geo" in needs and "geo" not in df.columns:
        if ctx.geo is None:
            raise QueryError("geo-ip filters need a table of address ranges")
        df = with_geo(df, ctx.geo)
    if "models" in needs:
        for name in dict.fromkeys(model_name(x) for x in leaves if x.name == "ml-model"):
            if name not in ctx.models:
                raise QueryError(f"no model is called {name!r}")
            df = with_prediction(df, ctx.models[name], f"ml_{name}")
    return df
