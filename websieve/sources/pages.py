"""The page table that queries run over, built from raw resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.content import content_class, headers
from ..functions.html import FRAGMENTS, html_view

PAGE_SCHEMA = f"""
    seq bigint, uri_hash string, uri string, referer_uri string, title string, description string,
    tags array<string>, created timestamp, updated timestamp, page_size bigint, data_hash string,
    features array<string>, source_server_id string,
    request map<string,string>, response map<string,string>, props map<string,string>,
    eval_text string, fragments {FRAGMENTS}, data binary, ip string"""


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def build_pages(resources: DataFrame, *, now: Column | None = None) -> DataFrame:
    """Pages from resources seq, uri, request, response (maps), data.

    HTML is read once for title, description, properties and text; other text is taken as it
    is; anything else has no text. One Python pass serves all standing queries.
    """
    kind = content_class(F.try_element_at("response", F.lit("content-type")))
    view = F.when(kind == "html", html_view(F.col("data")))
    stamp = now if now is not None else F.current_timestamp()
    df = resources.withColumn("_kind", kind).withColumn("_view", view)
    raw = F.when(F.col("_kind").isin("text", "xml", "javascript"), F.decode("data", "UTF-8")).otherwise(F.lit(""))
    return df.select(
        F.col("seq").cast("bigint"), F.md5(F.col("uri").cast("binary")).alias("uri_hash"), "uri", F.try_element_at("request", F.lit("referer")).alias("referer_uri"),
        F.col("_view.title").alias("title"), F.col("_view.description").alias("description"), F.array().cast("array<string>").alias("tags"),
        stamp.alias("created"), stamp.alias("updated"), F.octet_length("data").cast("bigint").alias("page_size"), F.md5("data").alias("data_hash"),
        F.array().cast("array<string>").alias("features"), _none("string").alias("source_server_id"), "request", "response",
        F.coalesce(F.col("_view.props"), F.create_map().cast("map<string,string>")).alias("props"), F.coalesce(F.col("_view.eval_text"), raw).alias("eval_text"),
        F.coalesce(F.col("_view.fragments"), F.array().cast(FRAGMENTS)).alias("fragments"), "data", _none("string").alias("ip"),
    )


def from_raw_pages(pages: DataFrame) -> DataFrame:
    """Resources from a table page_id, url, html."""
    return pages.select(
        F.col("page_id").alias("seq"), F.col("url").alias("uri"), F.create_map().cast("map<string,string>").alias("request"),
        F.create_map(F.lit("content-type"), F.lit("text/html")).alias("response"), F.col("html").cast("binary").alias("data"),
    )


def from_packets(resources: DataFrame) -> DataFrame:
    """Resources from packet rows file, pos, request, response header and data, exception."""
    req = headers(F.col("request"))
    return resources.where("exception is null").select(
        "file", "pos", F.try_element_at(req, F.lit("uri")).alias("uri"), req.alias("request"), headers(F.col("header")).alias("response"), "data",
    ).withColumn("seq", F.xxhash64("file", "pos")).drop("file", "pos")
