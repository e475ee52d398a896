"""Links: resolving, normalising, finding."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .columnar import columnar
from .html import attributes, decode, events

#: The schemes that links may have, and the length from which on they may not be.
SCHEMES, MAX_LENGTH = ("http", "https"), 2043
_SCHEME = re.compile(r"([A-Za-z]+):")
_TRIPLE = re.compile(r"(https?):///", re.I)
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
_NESTED = re.compile(r"https?://", re.I)
_WELL_FORMED = re.compile(r"[a-z][a-z0-9+.-]*://[^\s/?#<>\"{}|\\^`]+[^\s<>\"{}|\\^`]*\Z", re.I)
_BARE = re.compile(r"""href\s*=\s*(?:"([^"]*)"|'([^']*)')|(https?://[^\s"'<>]+)""", re.I)


def well_formed(url: str) -> bool:
    return "." in url and len(url) < MAX_LENGTH and _WELL_FORMED.match(url) is not None


def canonical(url: str) -> str:
    """Scheme and host in lower case, and a path at least of a slash."""
    p = urlsplit(url)
    return f"{p.scheme.lower()}://{p.netloc.lower()}{p.path or '/'}{'?' + p.query if p.query else ''}"


def resolve(source: str | None, candidate: str | None) -> list[str]:
    """The link a candidate stands for on a page, then the links nested in it; [] if none."""
    url = (candidate or "").strip()
    if not source or not url or len(url) > MAX_LENGTH or url.startswith("#"):
        return []
    scheme = _SCHEME.match(url)
    if scheme and scheme[1].lower() not in SCHEMES:
        return []
    base, url = urlsplit(source), url.partition("#")[0]
    if url.startswith("//"):
        url = f"{base.scheme}:{url}"
    url = _TRIPLE.sub(r"\1://", url, count=1)
    if "://" not in url:
        if url[:1] in ("/", "\\"):
            url = f"{base.scheme}://{base.hostname or ''}{url}"
        else:
            url = source[: max(source.rfind("/"), source.rfind("\\"))] + "/" + url
    url = _CONTROL.sub("", url)
    if not well_formed(url):
        return []
    found = [canonical(url)]
    found += [canonical(url[m.start() :]) for m in _NESTED.finditer(url, 1) if well_formed(url[m.start() :])]
    return found


def html_links(source: str, page: str) -> Iterator[tuple[str, str]]:
    """(tag, link) of a, script and link elements; a base element moves what follows it."""
    base = source
    for kind, tag, what in events(page):
        name = {"a": "href", "link": "href", "base": "href", "script": "src"}.get(tag) if kind == "open" else None
        to = attributes(what).get(name) if name else None
        if to and (found := resolve(base, to)):
            if tag == "base":
                base = found[0]
            else:
                yield tag, found[0]


def text_links(source: str, text: str) -> Iterator[tuple[str, str]]:
    """('text', link) of bare addresses and quoted href values in any text."""
    for m in _BARE.finditer(text):
        for link in resolve(source, m[1] or m[2] or m[3])[:1]:
            yield "text", link


LINKS = "array<struct<tag:string,target_uri:string>>"


@columnar(LINKS)
def _links(uri: pd.Series, data: pd.Series, kind: pd.Series) -> pd.Series:
    out = []
    for u, d, k in zip(uri, data, kind):
        find = html_links if k == "html" else text_links if k in ("xml", "text", "unknown") else None
        out.append([{"tag": t, "target_uri": x} for t, x in find(u, decode(d))] if find and u else [])
    return pd.Series(out)


def links_of(uri: Column, data: Column, kind: Column) -> Column:
    """Links of a page by its content class: html elements, or addresses in other text."""
    return _links(uri, data, kind)


@columnar("array<string>")
def resolve_link(source: pd.Series, candidate: pd.Series) -> pd.Series:
    return pd.Series([resolve(s, c) for s, c in zip(source, candidate)])


def host(uri: Column) -> Column:
    return F.lower(F.try_parse_url(uri, F.lit("HOST")))


def path(uri: Column) -> Column:
    return F.try_parse_url(uri, F.lit("PATH"))


#: Second-level labels below which a country's registry hands out names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "govt", "id", "info", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def public_suffix(name: Column) -> Column:
    """The suffix that names are registered under: the last label, or two (``co.uk``) below a country; null for null."""
    return F.coalesce(F.nullif(F.regexp_extract(name, rf"\.((?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})$", 1), F.lit("")), F.substring_index(name, ".", -1))


def robots_uri(uri: Column) -> Column:
    return F.concat(F.lower(F.try_parse_url(uri, F.lit("PROTOCOL"))), F.lit("://"), host(uri), F.lit("/robots.txt"))
