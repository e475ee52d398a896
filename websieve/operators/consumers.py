"""What can be read out of crawled resources, by name.

A consumer is a function from packet rows (file, pos, request, header, data, exception) to a
DataFrame. ``consume`` finds it by name; ``register`` adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.content import content_class, guess_type, headers
from ..functions.html import html_view, keywords_of
from ..functions.urls import links_of
from . import profile
from .windows import recent_distinct

KEYWORD_MEMORY = 10_000
Consumer = Callable[..., DataFrame]
_BY_NAME: dict[str, tuple[Consumer, str]] = {}


def register(name: str, about: str):
    """Decorator that registers a consumer under a name."""

    def add(consumer: Consumer) -> Consumer:
        _BY_NAME[name] = consumer, about
        return consumer

    return add


def consume(name: str, resources: DataFrame, **options) -> DataFrame:
    if name not in _BY_NAME:
        raise QueryError(f"no consumer is called {name!r}")
    return _BY_NAME[name][0](resources, **options)


def listing() -> list[tuple[str, str]]:
    return [(name, about) for name, (_, about) in sorted(_BY_NAME.items())]


def uri() -> Column:
    return F.try_element_at(headers(F.col("request")), F.lit("uri"))


def kind() -> Column:
    """The content class by the response's header, or by the data's first bytes where it has none."""
    given = F.nullif(F.trim(F.try_element_at(headers(F.col("header")), F.lit("content-type"))), F.lit(""))
    return content_class(F.coalesce(given, guess_type(F.col("data"))))


@register("uris", "the address of each resource")
def uris(resources: DataFrame) -> DataFrame:
    return resources.select("file", "pos", uri().alias("uri")).where("uri is not null")


@register("links", "links of html, xml and other text, with the element each comes from")
def links(resources: DataFrame) -> DataFrame:
    found = links_of(F.col("uri"), F.col("data"), F.col("kind"))
    return resources.where("data is not null").select("file", "pos", uri().alias("uri"), kind().alias("kind"), "data").select("file", "pos", "uri", F.inline(found))


@register("scripts", "sources of script elements as they stand in the page")
def scripts(resources: DataFrame) -> DataFrame:
    texts = resources.where("data is not null").select("file", "pos", uri().alias("uri"), kind().alias("kind"), "data").where("kind in ('html', 'text', 'xml')")
    own = F.filter(html_view("data")["links"], lambda x: (x["tag"] == "script") & (F.trim(x["target"]) != ""))
    return texts.select("file", "pos", "uri", F.posexplode(F.transform(own, lambda x: x["target"])).alias("at", "script"))


@register("keywords", "text and comments of pages, without those among the last ones seen")
def keywords(resources: DataFrame, memory: int = KEYWORD_MEMORY) -> DataFrame:
    """uri, place (file, pos, at), keyword of each keyword that isn't among the last new ones, in the packets' order."""
    texts = resources.where("data is not null").select("file", "pos", uri().alias("uri"), kind().alias("kind"), "data").where("kind in ('html', 'text', 'xml')")
    every = texts.select("file", "pos", "uri", F.posexplode(keywords_of(F.col("data"))).alias("at", "keyword")).select("uri", F.struct("file", "pos", "at").alias("place"), "keyword")
    return recent_distinct(every, F.col("keyword"), "place", memory)


@register("failures", "address, class and text of failed resources")
def failures(resources: DataFrame, kind: str | None = None) -> DataFrame:
    return profile.failures(resources, kind)


@register("totals", "counts, bytes and averages in one row")
def totals(resources: DataFrame) -> DataFrame:
    return profile.totals(resources)


@register("tables", "frequency tables of failures, hosts, suffixes, types, encodings and languages")
def tables(resources: DataFrame) -> DataFrame:
    return profile.packet_tables(resources)
