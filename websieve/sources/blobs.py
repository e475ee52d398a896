"""Blobs by the md5 of their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blob_rows(data: DataFrame, data_col: str = "data") -> DataFrame:
    """data_hash, data of each distinct blob."""
    return data.where(F.col(data_col).isNotNull()).select(F.md5(data_col).alias("data_hash"), F.col(data_col).alias("data")).dropDuplicates(["data_hash"])


def missing_blobs(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming blobs (data_hash, data) that the store lacks, to be appended."""
    return incoming.join(store.select("data_hash"), "data_hash", "left_anti")


def put_blobs(path: str, incoming: DataFrame) -> None:
    """Append to a Parquet folder what it doesn't have yet."""
    spark = incoming.sparkSession
    new = blob_rows(incoming)
    try:
        new = missing_blobs(spark.read.schema("data_hash string, data binary").parquet(path), new)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def get_blob(store: DataFrame, data_hash: str) -> DataFrame:
    return store.where(F.col("data_hash") == data_hash.lower())


def page_text(store: DataFrame, data_hash: str, kind: str = "raw", distinct: bool = True) -> DataFrame:
    """The text fragments of a stored page, in order, each once unless told otherwise."""
    from ..functions.html import fragments_of, pick_fragments

    picked = pick_fragments(fragments_of(F.col("data")), kind, distinct=distinct)
    return get_blob(store, data_hash).select("data_hash", F.posexplode(picked).alias("pos", "text"))
