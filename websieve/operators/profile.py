"""Profiles of packets: sizes, failures and frequency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import failure_class, failure_type, guess_type, headers
from ..functions.urls import host, public_suffix

DIMENSIONS = ("exception", "tld", "host", "content_type", "encoding", "language")


def seconds(text: Column) -> Column:
    """``hh:mm:ss.fff`` as seconds; null for anything else."""
    p = F.split(text, ":")
    return F.when(F.size(p) == 3, F.get(p, F.lit(0)).try_cast("double") * 3600 + F.get(p, F.lit(1)).try_cast("double") * 60 + F.get(p, F.lit(2)).try_cast("double"))


def described(resources: DataFrame) -> DataFrame:
    """Resources with what the tables count: exception, tld, host, content_type, encoding, language."""
    req, resp = headers(F.col("request")), headers(F.col("header"))
    df = resources.withColumn("_req", req).withColumn("_resp", resp)
    h = host(F.try_element_at("_req", F.lit("uri")))
    given = F.nullif(F.try_element_at("_resp", F.lit("content-type")), F.lit(""))
    kind = F.when(given.isNotNull(), given).when(F.col("data").isNotNull(), F.concat(F.lit("(GUESS) "), guess_type(F.col("data"))))
    return df.select(
        "*", h.alias("host"), public_suffix(h).alias("tld"), kind.alias("content_type"), F.try_element_at("_resp", F.lit("content-encoding")).alias("encoding"),
        F.try_element_at("_resp", F.lit("content-language")).alias("language"), seconds(F.try_element_at("_req", F.lit("responsetime"))).alias("response_s"),
    ).drop("_req", "_resp")


def totals(resources: DataFrame) -> DataFrame:
    """One row: counts, failures and their share, bytes, averages over successful resources."""
    failed = F.coalesce(F.trim("exception"), F.lit("")) != ""
    size = F.coalesce(F.octet_length("data"), F.lit(0)).cast("bigint")
    return described(resources).agg(
        F.count(F.lit(1)).alias("resources"),
        F.count_if(failed).alias("failures"),
        (F.count_if(failed) * 100.0 / F.count(F.lit(1))).alias("failure_percent"),
        F.sum(F.coalesce(F.octet_length("request"), F.lit(0))).alias("request_bytes"),
        F.sum(F.coalesce(F.octet_length("header"), F.lit(0))).alias("header_bytes"),
        F.sum(size).alias("data_bytes"),
        F.avg(F.when(~failed, size)).alias("average_bytes"),
        F.avg("response_s").alias("average_response_s"),
        F.count_distinct("host").alias("hosts"),
        F.count_distinct("content_type").alias("content_types"),
    )


def frequencies(df: DataFrame, *dimensions: str) -> DataFrame:
    """dimension, value, n for each column, in one pass; nulls aren't counted."""
    pairs = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return df.select(F.inline(pairs)).where("value is not null").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def packet_tables(resources: DataFrame) -> DataFrame:
    """Frequency tables of all dimensions."""
    df = described(resources).withColumn("exception", F.when(F.trim("exception") != "", failure_type(F.col("exception"))))
    return frequencies(df, *DIMENSIONS)


def summary(tables: DataFrame, total: int) -> DataFrame:
    """Rows above a hundredth of the total, all rows for exceptions and encodings, with shares."""
    always = F.col("dimension").isin("exception", "encoding")
    return tables.where(always | (F.col("n") > total / 100)).withColumn("percent", F.col("n") * 100.0 / total).orderBy("dimension", F.col("n").desc(), "value")


def failures(resources: DataFrame, kind: str | None = None) -> DataFrame:
    """uri, class and text of failed resources, all or of one class."""
    df = resources.where(F.trim("exception") != "").select(F.try_element_at(headers(F.col("request")), F.lit("uri")).alias("uri"), failure_class(F.col("exception")).alias("class"), "exception")
    return df if kind is None else df.where(F.col("class") == kind)
