"""Queries that SQL can't express, against brute-force versions over whole small tables."""

from __future__ import annotations

from collections import deque
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from oracle import SF
from websieve.errors import QueryError
from websieve.functions.language import detect
from websieve.operators import frontier, store, windows
from websieve.operators.frontier import decide, nth_link, rule_regex, rule_regex_column
from websieve.plans.compiler import compile_query
from websieve.queries import QUERIES
from websieve.sources.packets import resources_of

VOID = "area base br col embed hr img input link meta param source track wbr".split()


class Reader(HTMLParser):
    """(innermost element, text) of text nodes, and comments, with Python's own parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.stack, self.texts, self.every = [], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        text = " ".join(data.split())
        if text and (self.stack[-1:] or [""])[0] not in ("script", "style"):
            self.texts.append(((self.stack[-1:] or [""])[0], text))
            self.every.append(text)

    def handle_comment(self, data):
        if data.strip():
            self.every.append(" ".join(data.split()))


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def test_page_fragments(spark, pages):
    got = sorted((r.id, r.pos, r.tag, r.text) for r in QUERIES["page_fragments"](spark, SF).collect())
    assert got == sorted((i, k, tag, text) for i, p in pages.items() for k, (tag, text) in enumerate(Reader(p.html).texts))


def test_fragment_text(spark, pages):
    want = [i for i, p in pages.items() if any(tag in ("p", "h1", "h2", "strong", "div") and "the" in text.lower() for tag, text in Reader(p.html).texts)]
    assert sorted(r.id for r in QUERIES["fragment_text"](spark, SF).collect()) == sorted(want) and 0 < len(want)


def last_n(rows, n):
    """Rows (order, value) whose value isn't among the last n that went through."""
    recent, out = deque(maxlen=n), []
    for at, value in sorted(rows):
        if value not in recent:
            recent.append(value)
            out.append(at)
    return out


def test_keywords(spark, pages):
    rows = [((i, k), text) for i, p in pages.items() if i % 7 for k, text in enumerate(dict.fromkeys(Reader(p.html).every))]
    got = sorted((r.pos, r.at) for r in QUERIES["consume_keywords"](spark, SF).collect())
    assert got == last_n(rows, 10_000) and len(got) < len(rows)


def test_distinct_window(spark):
    rows = [(r.event_id, r.user_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    assert sorted(r.event_id for r in QUERIES["distinct_window_exact"](spark, SF).collect()) == last_n(rows, 20)


def test_distinct_window_of_odd_values(spark):
    rows = [(i, [None, "", "a", "b", "c", "d"][i * i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "at int, v string").repartition(4)
    assert sorted(r.at for r in windows.distinct_window(df, F.col("v"), 2, "at").collect()) == last_n(rows, 2)
    pairs = windows.distinct_window(df, F.struct("v", F.lit(1)), 2, "at")
    assert sorted(r.at for r in pairs.collect()) == last_n(rows, 2)


def test_repeated_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    context = {}
    for d in docs:
        at = d.text.lower().find("tion")
        if at >= 0:
            context[d.doc_id] = d.text[max(0, at - 20) : at + 4 + 20]
    seen, want = deque(maxlen=1000), []
    for i in sorted(context):
        if context[i] not in seen:
            want.append(i)
        seen.append(context[i])
    assert sorted(r.id for r in QUERIES["repeated_text"](spark, SF).collect()) == want


def test_random_share(spark):
    df = spark.range(2_000_000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("uri_hash"))
    one, two = (compile_query("random:0.0001").apply(df.repartition(n)).select("uri_hash") for n in (2, 5))
    assert 120 < one.count() < 290 and one.exceptAll(two).count() == two.exceptAll(one).count() == 0
    assert QUERIES["random_pages_filter"](spark, SF).count() <= 3


def test_detected_language(spark):
    rows = [r for r in QUERIES["detected_language"](spark, SF).collect()]
    long = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text.split()) >= 40}
    own = [r for r in rows if r.doc_id in long]
    assert len(rows) == 200 and sum(r.lang == r.detected for r in own) >= 0.9 * len(own)


@pytest.mark.parametrize(
    ("text", "code"),
    [("это русский текст", "ru"), ("これは日本語の文章です", "ja"), ("这是中文", "zh"), ("한국어 문장입니다", "ko"), ("αυτό είναι ελληνικά", "el"), ("זה טקסט בעברית", "he"), ("هذا نص عربي", "ar"), ("นี่คือภาษาไทย", "th"), ("यह हिन्दी है", "hi"), ("1234 !!", None), ("", None)],
)
def test_scripts(text, code):
    assert detect(text) == code


RULES = ["/a\\E(", "/b[", "/c.d+e", "/f*g", "/h$", "/i^j|k", "/l{2}", "/m?n=*o", "$", "*", "/p\\Q*", "/q$r"]
PATHS = ["/a\\E(x", "/b[1", "/c.d+e", "/cxd+e", "/fxxg", "/fg", "/h", "/hi", "/i^j|k", "k", "/l{2}", "/ll", "/m?n=xo", "/mn=o", "/", "/p\\Qz", "/q$r", "/q"]


def test_robots_rules_of_any_characters(spark):
    import re

    df = spark.createDataFrame([(r, p) for r in RULES for p in PATHS], "rule string, path string")
    got = {(r.rule, r.path): r.hit for r in df.select("*", F.regexp_like("path", rule_regex_column(F.col("rule"))).alias("hit")).collect()}
    assert got == {(r, p): re.search(rule_regex(r), p) is not None for r in RULES for p in PATHS} and any(got.values())
    files = spark.createDataFrame([("a.org", "User-agent: *\n" + "".join(f"Disallow: {r}\n" for r in RULES[:8]))], "host string, text string")
    links = spark.createDataFrame([("http://a.org/c.d+e",), ("http://a.org/ok",), ("http://b.org/c.d+e",), (None,)], "target_uri string")
    out = frontier.blocked_by_robots(links, frontier.robots_rules(files), "sieve")
    assert sorted((str(r.target_uri), r.blocked_by_robots) for r in out.collect()) == [("None", False), ("http://a.org/c.d+e", True), ("http://a.org/ok", False), ("http://b.org/c.d+e", False)]


def test_regex_speaks_the_executors_dialect(spark):
    df = spark.createDataFrame([("añb",), ("12",)], "eval_text string")
    assert [r.query_tags for r in compile_query(r"regex:(?<w>\p{L}+) regex::(?<w>\p{L}+)").apply(df).collect()] == [["añb"]]
    for bad in ("regex:(?P<x>b)", "regex:(", "regex:[a"):
        with pytest.raises(QueryError):
            compile_query(bad)


def test_upsert_keeps_its_time(spark):
    own = spark.createDataFrame([("w", "h", "d", None, None)], "workspace_id string, uri_hash string, data_hash string, created timestamp, updated timestamp")
    out = store.upsert(own.limit(0), own)
    assert out.collect() == out.collect() and out.first().created is not None and out.first().created == out.first().updated


@pytest.mark.parametrize("n", [1, 7, 500, 999, 1000, 5000])
def test_quota(spark, n):
    rows = [(None if i % 50 == 0 else i * 37 % 90, f"u{i:04d}") for i in range(1000)]
    df = spark.createDataFrame(rows, "priority bigint, target_uri string").repartition(3)
    known = sorted(r for r in rows if r[0] is not None)
    got = nth_link(df, n)
    assert (tuple(got) if got else None) == (known[n - 1] if n <= len(known) else None)
    links = df.select("*", F.lit(True).alias("can_be_discarded"), F.lit(0).alias("chunk_sequence")).withColumn("target_uri", F.concat(F.lit("http://a.org/"), "target_uri"))
    assert decide(links, quota_left=n).where("reason = 'quota'").count() == max(0, len(known) - n)


def test_packets_tell_where_resources_are_left_out():
    packet = b"<resources>" + b"<resource><request>r</request></resource>" * 5 + b"</resources>"
    assert [r[-1] for r in resources_of(packet)] == [None] * 5
    some = list(resources_of(packet, 2))
    assert len(some) == 3 and "first 2" in some[-1][-1]
