"""Each predicate on hand-made pages."""

from __future__ import annotations

import pytest

from websieve.operators.classify import train
from websieve.plans.compiler import Context, compile_query
from websieve.sources.pages import PAGE_SCHEMA

HTML = b"<html><head><title>T</title><script>var t='</p>secret'</script></head><body><p>Hello <b>World</b><a href='/x'>go</a><br></body>"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        {"seq": 1, "uri_hash": "aa", "uri": "https://www.boards.example/t/A", "title": "One title", "tags": ["red fox"], "data_hash": "ABC", "request": {"referer": "http://r.example.org"}, "response": {"content-type": "text/html"},
         "props": {"og_type": "article"}, "eval_text": "Hello World copper is the metal of wires", "data": HTML, "ip": "1.0.0.9", "lang": "en"},
        {"seq": 2, "uri_hash": "bb", "uri": "https://lex.example.org/entry/B", "title": None, "tags": [], "data_hash": "abd", "request": {}, "response": {}, "props": {"og_type": " "}, "eval_text": "", "data": None, "ip": None, "lang": None},
        {"seq": 3, "uri_hash": "cc", "uri": None, "title": None, "tags": None, "data_hash": None, "request": None, "response": None, "props": None, "eval_text": None, "data": None, "ip": "10.0.0.1", "lang": "fr"},
    ]
    schema = PAGE_SCHEMA.replace("fragments array<struct<tag:string,text:string>>, ", "") + ", lang string"
    assert "fragments" not in schema
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("hello", [1]), ("HELLO", [1]), ("-hello", [2, 3]), ('"metal of"', [1]), ("text:hello", [1]), ("text:world", []), ("text:secret", []), ("hash:abc", [1]), ("hash:", []), ("filetype:html", [1]),
        ("site:boards.example OR site:lex.example.org OR site:press.example.net", [1, 2]), ("site:BOARDS", [1]), ("uri:/t/A", [1]), ("uri:/t/a", []), ("title:One", [1]), ("title:one", []),
        ("tag:FOX", [1]), ("has:og_type", [1]), ("has:title", [1]), ("has:nothing", []), ("property(og_type):ART", [1]), ("request-header(Referer):example", [1]), ("response-header(content-type):HTML", [1]),
        ("lang:fr", [3]), ("regex:c[a-z]+r", [1]), ("xpath://a[@href]", [1]), ("xpath://h1", []), ("xpath://a/@href", [1]), ("random:0.5", []), ("", []), ("lang::*", []), ("-title:One -site:lex", [3]),
    ],
)
def test_predicates(pages, text, ids):
    assert sorted(r.seq for r in compile_query(text).apply(pages).collect()) == ids


@pytest.mark.parametrize(
    ("text", "tags"),
    [
        ("hello site::*", ["www.boards.example"]), ("hello lang::* lang::*", ["en"]), ("hello lang:en:* title::*", ["en"]), ('hello "regex::(metal) of"', ["metal_of", "metal"]),
        ("hello has::og_type property(og_type)::*", ["article"]), ("hello tag::red", ["red"]), ("lang:en OR lang:fr uri::*", ["https://www.boards.example/t/A"]),
    ],
)
def test_tags(pages, text, tags):
    first = compile_query(text).apply(pages).orderBy("seq").first()
    assert first.query_tags == tags


def test_geo(spark, pages):
    geo = spark.createDataFrame([(1 << 24, (1 << 24) + 255, "New York", "US", "NY", 40.7, -74.0)], "ip_from bigint, ip_to bigint, city string, country string, subdivision string, lat double, lon double")
    hit = lambda text: [(r.seq, r.query_tags) for r in compile_query(text, Context(geo=geo)).apply(pages).collect()]
    assert hit("geo-ip-city:New_York:*") == [(1, ["New_York", "US"])]
    assert hit("geo-ip-country:US geo-ip-subdivision::*") == [(1, ["NY"])]
    assert hit('"geo-ip-ll:[[40,-75],[41,-73]]" geo-ip-ll::*') == [(1, ["[40.700,-74.000]"])]
    assert hit('"geo-ip-ll:[[0,0],[1,1]]"') == []


def test_model(spark, pages):
    rows = spark.createDataFrame([("copper iron tin metal", "metal")] * 6 + [("car bus train road", "travel")] * 6, "text string, category string")
    ctx = Context(models={"m": train(rows, features=256)})
    assert [r.query_tags for r in compile_query("ml-model(m,0.5):metal ml-model(m,any)::* copper", ctx).apply(pages).collect()] == [["metal"]]
    assert compile_query("ml-model(m,1.0):metal", ctx).apply(pages).count() == 0
