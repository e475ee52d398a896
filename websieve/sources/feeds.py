"""Link feeds as JSON files that something else has fetched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_links(spark: SparkSession, path: str, *, url: str = "url", title: str = "title", created: str = "created_utc") -> DataFrame:
    """uri, title, created from JSON lines of submissions with an epoch or text date."""
    schema = f"`{url}` string, `{title}` string, `{created}` string"
    stamp = F.coalesce(F.timestamp_seconds(F.col(created).try_cast("double")), F.try_to_timestamp(created))
    return spark.read.schema(schema).json(path).where(F.col(url).isNotNull()).select(F.col(url).alias("uri"), F.col(title).alias("title"), stamp.alias("created"))
