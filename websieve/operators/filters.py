"""Every predicate of the query language, as Column builders over the page schema.

Pages have the columns of ``sources.pages.PAGE_SCHEMA``. A blank argument (or ``*``) matches
whatever has the looked-at value at all. Comparisons that are documented as ignoring case
lower both sides.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans.nodes import Leaf
from ..plans.registry import RESULT, STREAM, TEXT, Match, page_filter

CORE_TAGS = ("p", "h1", "h2", "strong", "div")
WINDOW_FIELDS = ("domain", "host", "ip", "title", "referer", "datahash", "tags")
RANDOM_LEAST, RANDOM_MOST = 1e-7, 1e-4


def as_tag(c: Column) -> Column:
    return F.replace(F.trim(c), F.lit(" "), F.lit("_"))


def yes(c: Column) -> Column:
    """Null counts as no match."""
    return F.coalesce(c, F.lit(False))


def has(c: Column, needle: str) -> Column:
    return yes(F.contains(c, F.lit(needle))) if needle else c.isNotNull()


def has_lower(c: Column, needle: str) -> Column:
    return has(F.lower(c), needle.lower())


def one(c: Column) -> Column:
    return F.array(as_tag(c))


def host_of(uri: Column) -> Column:
    return F.lower(F.try_parse_url(uri, F.lit("HOST")))


@page_filter("", blank_reduces=False, cost=30, inputs=(TEXT,), form="word or \"phrase\"", about="text holds the word, in any case", hidden=False)
def _text(leaf: Leaf, ctx) -> Match:
    return Match(has_lower(F.col("eval_text"), leaf.arg))


@page_filter("text", cost=100, inputs=(STREAM,), form="text:word", about="a paragraph, heading, strong or div holds the word", needs=("fragments",))
def _fragment(leaf: Leaf, ctx) -> Match:
    word = leaf.arg.lower()
    return Match(yes(F.exists("fragments", lambda f: f["tag"].isin(*CORE_TAGS) & F.contains(F.lower(f["text"]), F.lit(word)))))


@page_filter("hash", blank_reduces=False, cost=1, inputs=(RESULT,), form="hash:md5", about="the data has this md5")
def _hash(leaf: Leaf, ctx) -> Match:
    c = F.lower(F.col("data_hash"))
    return Match(yes(c == leaf.arg.lower()) if leaf.arg else c.isNotNull(), F.array(c))


def _check_window(leaf: Leaf) -> None:
    if leaf.key not in WINDOW_FIELDS:
        raise QueryError(f"distinct-window needs one of {', '.join(WINDOW_FIELDS)}")


@page_filter("distinct-window", cost=9_999_999, inputs=(RESULT,), form="distinct-window(field):n", about="the field's value isn't among the last n emitted", functional=True, stateful=True, check=_check_window)
def _distinct_window(leaf: Leaf, ctx) -> Match:
    return Match(window_field(leaf.key))


def window_field(name: str) -> Column:
    """The compared value; rows without one share the empty value."""
    by = {
        "domain": F.regexp_extract(F.coalesce(host_of(F.col("uri")), F.lit("")), r"([^.]+\.[^.]+)$|^([^.]*)$", 0),
        "host": host_of(F.col("uri")), "ip": F.col("ip"), "title": F.col("title"), "referer": F.col("referer_uri"),
        "datahash": F.col("data_hash"), "tags": F.array_join("tags", " "),
    }
    return F.coalesce(by[name], F.lit(""))


def window_size(leaf: Leaf) -> int:
    return min(1000, max(1, int(leaf.arg))) if re.fullmatch(r"\d+", leaf.arg.strip()) else 1000


@page_filter("filetype", blank_reduces=False, cost=1, inputs=(RESULT,), form="filetype:type", about="the response's content type holds this")
def _filetype(leaf: Leaf, ctx) -> Match:
    c = F.try_element_at("response", F.lit("content-type"))
    return Match(has(c, leaf.arg), one(c))


def _geo(field: str, extra: tuple[str, ...] = ()):
    def build(leaf: Leaf, ctx) -> Match:
        cols = [as_tag(F.col("geo")[f]) for f in (field, *extra)]
        hit = cols[0].isNotNull() if not leaf.arg else F.exists(F.array(*cols), lambda c: yes(F.contains(c, F.lit(leaf.arg))))
        return Match(yes(hit), F.array(*cols))

    return build


page_filter("geo-ip-city", cost=500, inputs=(RESULT,), form="geo-ip-city:name", about="the host's city or country holds this", needs=("geo",))(_geo("city", ("country",)))
page_filter("geo-ip-country", cost=500, inputs=(RESULT,), form="geo-ip-country:name", about="the host's country holds this", needs=("geo",))(_geo("country"))
page_filter("geo-ip-subdivision", cost=500, inputs=(RESULT,), form="geo-ip-subdivision:name", about="the host's subdivision holds this", needs=("geo",))(_geo("subdivision"))

_BOX = re.compile(r"\[?\[\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\]\s*,\s*\[\s*(-?[\d.]+)\s*,\s*(-?[\d.]+)\s*\]\]?")


def _check_box(leaf: Leaf) -> None:
    if leaf.arg and not _BOX.fullmatch(leaf.arg.strip()):
        raise QueryError("geo-ip-ll needs a box [[lat,long],[lat,long]]")


@page_filter("geo-ip-ll", cost=500, inputs=(RESULT,), form="geo-ip-ll:[[lat,long],[lat,long]]", about="the host lies in the box", needs=("geo",), check=_check_box)
def _geo_box(leaf: Leaf, ctx) -> Match:
    lat, lon = F.col("geo")["lat"], F.col("geo")["lon"]
    hit = lat.isNotNull()
    if leaf.arg:
        a, b, c, d = map(float, _BOX.fullmatch(leaf.arg.strip()).groups())
        hit = lat.between(min(a, c), max(a, c)) & lon.between(min(b, d), max(b, d))
    return Match(yes(hit), F.array(F.format_string("[%.3f,%.3f]", lat, lon)))


def _prop(source: str, key: str) -> Column:
    return F.try_element_at(source, F.lit(key.lower()))


@page_filter("has", cost=2, inputs=(RESULT,), form="has:property", about="the page has the property, or a title or description")
def _has(leaf: Leaf, ctx) -> Match:
    key = leaf.arg.lower()
    own = F.col(key) if key in ("title", "description") else F.lit(None).cast("string")
    c = F.coalesce(_prop("props", key), own) if key else F.lit(None).cast("string")
    return Match(F.trim(F.coalesce(c, F.lit(""))) != "" if key else F.size("props") > 0, F.array(as_tag(c)))


@page_filter("lang", blank_reduces=False, cost=50, inputs=(TEXT,), form="lang:code", about="the detected language has this code", needs=("lang",))
def _lang(leaf: Leaf, ctx) -> Match:
    c = F.col("lang")
    return Match(yes(c == leaf.arg) if leaf.arg else c.isNotNull() & (c != ""), F.array(c))


def model_name(leaf: Leaf) -> str:
    return (leaf.key or "").split(",")[0].strip()


def model_confidence(leaf: Leaf) -> float:
    """0.01 where omitted or ``any``, 0.98 where it isn't a number, else clamped to 0..1."""
    _, comma, text = (leaf.key or "").partition(",")
    if not comma or text.strip().lower() in ("", "any"):
        return 0.01
    try:
        return min(1.0, max(0.0, float(text)))
    except ValueError:
        return 0.98


def _check_model(leaf: Leaf) -> None:
    if not model_name(leaf):
        raise QueryError("ml-model needs a model's name")


@page_filter("ml-model", cost=500, inputs=(TEXT,), form="ml-model(name,confidence):class", about="the model's class holds this, with more confidence", functional=True, needs=("models",), check=_check_model)
def _model(leaf: Leaf, ctx) -> Match:
    p = F.col(f"ml_{model_name(leaf)}")
    hit = (p["confidence"] > model_confidence(leaf)) & (p["label"] != "")
    return Match(yes(hit & F.contains(p["label"], F.lit(leaf.arg)) if leaf.arg else hit), one(p["label"]))


def _mapped(source: str):
    def build(leaf: Leaf, ctx) -> Match:
        c = _prop(source, leaf.key or "")
        return Match(has_lower(c, leaf.arg.replace("*", "")), one(c))

    return build


page_filter("property", cost=50, inputs=(RESULT, STREAM), form="property(key):value", about="the property holds this, in any case", functional=True)(_mapped("props"))
page_filter("request-header", cost=1, inputs=(RESULT, STREAM), form="request-header(key):value", about="the request header holds this, in any case", functional=True)(_mapped("request"))
page_filter("response-header", cost=1, inputs=(RESULT, STREAM), form="response-header(key):value", about="the response header holds this, in any case", functional=True)(_mapped("response"))


def random_share(leaf: Leaf) -> float:
    try:
        return min(RANDOM_MOST, max(RANDOM_LEAST, float(leaf.arg)))
    except ValueError:
        return RANDOM_MOST


@page_filter("random", cost=1, inputs=(), form="random:probability", about="a share of all pages, the same ones each time for one seed")
def _random(leaf: Leaf, ctx) -> Match:
    draw = F.pmod(F.xxhash64(F.col("uri_hash"), F.lit(ctx.seed)), F.lit(1 << 40)) / float(1 << 40)
    return Match(draw < random_share(leaf))


def regex_groups(pattern: str) -> int:
    """How many groups a pattern has in the dialect that executors use; QueryError if it has a flaw.

    The running session's JVM compiles it; without one, Python's dialect stands in.
    """
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            return re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups
        return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (re.error, Py4JError, PySparkException) as e:
        raise QueryError(f"regex: {str(e).splitlines()[0]}") from e


def _check_regex(leaf: Leaf) -> None:
    regex_groups(leaf.arg)


@page_filter("regex", blank_reduces=False, cost=50, inputs=(TEXT,), form="regex:pattern", about="the text has a match; its groups become tags", check=_check_regex)
def _regex(leaf: Leaf, ctx) -> Match:
    text = F.col("eval_text")
    if not leaf.arg:
        return Match(text.isNotNull())
    found = F.array(*(as_tag(F.regexp_extract(text, leaf.arg, k)) for k in range(regex_groups(leaf.arg) + 1)))
    return Match(yes(text.rlike(leaf.arg)), F.filter(found, lambda t: t != ""))


@page_filter("site", blank_reduces=False, cost=1, inputs=(RESULT,), form="site:host", about="the host holds this")
def _site(leaf: Leaf, ctx) -> Match:
    c = host_of(F.col("uri"))
    return Match(has(c, leaf.arg.lower()), one(c))


@page_filter("tag", cost=9_999_999, inputs=(RESULT,), form="tag:name", about="one of the page's tags holds this, in any case")
def _tag(leaf: Leaf, ctx) -> Match:
    hit = F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(leaf.arg.lower()))) if leaf.arg else F.size("tags") > 0
    return Match(yes(hit), F.array(as_tag(F.lit(leaf.arg))) if leaf.arg else F.col("tags"))


@page_filter("title", blank_reduces=False, cost=1, inputs=(RESULT,), form="title:text", about="the title holds this")
def _title(leaf: Leaf, ctx) -> Match:
    return Match(has(F.col("title"), leaf.arg))


@page_filter("uri", cost=1, inputs=(RESULT,), form="uri:text", about="the address holds this")
def _uri(leaf: Leaf, ctx) -> Match:
    return Match(has(F.col("uri"), leaf.arg), one(F.col("uri")))


@page_filter("query", cost=1, inputs=(RESULT,), form="query(access-key):*", about="the page passes another workspace's query", functional=True)
def _query(leaf: Leaf, ctx) -> Match:
    raise QueryError("query(...) is replaced by its own filters before compiling")


@page_filter("xpath", cost=1000, inputs=(STREAM,), form="xpath:expression", about="the page's tree has a node for the expression")
def _xpath(leaf: Leaf, ctx) -> Match:
    from ..functions.html import xpath_matches

    return Match(yes(xpath_matches(leaf.arg)(F.col("data"))))
