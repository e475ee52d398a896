"""Content types, header blocks and failed requests, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status codes that are told apart in a failure's text, as "(404)".
HTTP_CODES = (300, 302, 308, 400, 401, 403, 404, 405, 406, 410, 429, 496, 500, 502, 503, 520, 999)
#: Phrases of failures, tried in this order after the codes.
FAILURES = (
    ("Blocked", (" blocked,",)),
    ("DNSResolve", ("The remote name could not be resolved:",)),
    ("Connection", ("established connection failed because connected host has failed to respond", "No connection could be made because the target machine actively refused it")),
)
TIMEOUT_CLASS = "System.TimeoutException"
#: A response of these types isn't downloaded.
BLOCKED_TYPES = ("image/", "video/", "binary/", "application/vnd.", "audio/")
ADULT_RATING = "RTA-5042-1996-1400-1577-RTA"


def any_of(hits) -> Column:
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def failure_class(text: Column) -> Column:
    """HTTP<code>, Timeout, Blocked, DNSResolve, Connection or Unsure."""
    t = F.coalesce(text, F.lit(""))
    out = F.when(F.trim(t) == "", "Unsure")
    for code in HTTP_CODES:
        out = out.when(F.contains(t, F.lit(f"({code})")), f"HTTP{code}")
    out = out.when(F.startswith(t, F.lit(TIMEOUT_CLASS)), "Timeout")
    for name, phrases in FAILURES:
        out = out.when(any_of(F.contains(t, F.lit(p)) for p in phrases), name)
    return out.otherwise("Unsure")


def failure_type(text: Column) -> Column:
    """The class name a failure's text starts with, up to the first colon or line end."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([\w.]+)", 1)


def content_type(raw: Column) -> Column:
    """struct<media, sub, attrs map> of ``media/sub; key=value``; media and sub may be ''."""
    parts = F.transform(F.split(F.coalesce(raw, F.lit("")), ";"), lambda p: F.trim(p))
    kind = F.get(parts, F.lit(0))
    pairs = F.filter(F.slice(parts, 2, 1000), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substring(p, F.instr(p, F.lit("=")) + 1, F.length(p))).alias("value")))
    return F.struct(
        F.substring_index(kind, "/", 1).alias("media"),
        F.when(F.contains(kind, F.lit("/")), F.substring(kind, F.instr(kind, F.lit("/")) + 1, F.length(kind))).otherwise("").alias("sub"),
        first_wins(entries).alias("attrs"),
    )


def content_type_text(c: Column) -> Column:
    attrs = F.transform(F.map_entries(c["attrs"]), lambda e: F.concat(F.lit("; "), e["key"], F.lit("="), e["value"]))
    return F.concat(c["media"], F.when(c["sub"] == "", "").otherwise(F.concat(F.lit("/"), c["sub"])), F.array_join(attrs, ""))


def content_class(raw: Column) -> Column:
    """html, xml, javascript, text, binary or unknown."""
    t = F.lower(F.coalesce(raw, F.lit("")))
    return (
        F.when(F.trim(t) == "", "unknown")
        .when(F.contains(t, F.lit("html")), "html")
        .when(F.contains(t, F.lit("javascript")) | F.contains(t, F.lit("ecmascript")), "javascript")
        .when(F.contains(t, F.lit("xml")), "xml")
        .when(F.startswith(t, F.lit("text/")), "text")
        .otherwise("binary")
    )


def guess_type(data: Column) -> Column:
    """A content type from the first 256 bytes; no bytes are application/x-empty."""
    head = F.lower(F.decode(F.substring(data, 1, 256), "ISO-8859-1"))
    known = (("%pdf-", "application/pdf"), ("\x89png", "image/png"), ("gif8", "image/gif"), ("\xff\xd8\xff", "image/jpeg"), ("pk\x03\x04", "application/zip"), ("\x1f\x8b", "application/gzip"), ("<?xml", "text/xml"))
    out = F.when(data.isNull() | (F.octet_length(data) == 0), "application/x-empty")
    out = out.when(F.ltrim(head).rlike(r"^<(!doctype html|html|head|body|!--)"), "text/html")
    for mark, kind in known:
        out = out.when(F.startswith(F.ltrim(head), F.lit(mark)), kind)
    return out.when(F.ltrim(head).rlike(r"^[\[{]"), "application/json").when(~F.contains(head, F.lit("\x00")), "text/plain").otherwise("application/octet-stream")


def first_wins(entries: Column) -> Column:
    """A map of (key, value) entries in which the first of equal keys wins."""
    keys = F.transform(entries, lambda e: e["key"])
    kept = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), (F.array_position(keys, e["key"]) == i + 1).alias("first"))), lambda e: e["first"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"])))


def headers(block: Column) -> Column:
    """A header block as a map: names lower-cased, the first of a name wins."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.substring(x, F.instr(x, F.lit(":")) + 1, F.length(x))).alias("value")))
    return first_wins(F.filter(entries, lambda e: e["key"] != ""))


def block_reason(length: Column, response: Column, limit: int = 1_000_000) -> Column:
    """Why a response isn't downloaded; null if it is."""
    kind = F.coalesce(F.try_element_at(response, F.lit("content-type")), F.lit(""))
    return (
        F.when(length > limit, F.lit(f"length exceeds {limit}"))
        .when(F.try_element_at(response, F.lit("rating")) == ADULT_RATING, F.lit("adult rating"))
        .when(any_of(F.startswith(kind, F.lit(t)) for t in BLOCKED_TYPES), F.concat(F.lit("content type "), kind))
    )
