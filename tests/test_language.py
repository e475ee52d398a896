"""Query texts: tokens, grammar, canonical form, errors, cost order."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from websieve.errors import QueryError
from websieve.plans.compiler import Context, compile_query, distill
from websieve.plans.explain import explain, supported_filters
from websieve.plans.nodes import Either
from websieve.plans.parser import parse
from websieve.plans.tokens import strip_comments, tokenise


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("a  b\tc", ["a", "b", "c"]), ('"two words" x', ["two words", "x"]), (r'say\"so\" y', ['say"so"', "y"]), ('title:"a b" c', ["title:a b", "c"]), ('"open end', ["open end"]), ("", [])],
)
def test_tokens(text, tokens):
    assert tokenise(strip_comments(text)) == tokens


def test_comments():
    assert strip_comments("a // b\n//c\n d") == "a d"
    assert strip_comments("uri:http://x") == "uri:http://x"
    assert strip_comments("uri:http://x", strict_compat=True) == "uri:http:"
    assert strip_comments('"a // b"') == '"a // b"'


@pytest.mark.parametrize(
    ("text", "filters", "taggers"),
    [
        ("lang:*:*", 0, 1), ("lang::*", 0, 1), ("lang:en:*", 1, 1), ("-lang:en:*", 1, 0), ("lang:*", 0, 0), ("ml-model(topics,0.9):*", 1, 0),
        ("-ml-model(topics,0.9)", 1, 0), ("a and b AND c", 3, 0), ("site:a OR site:b OR site:c d", 2, 0), ("a OR", 1, 0), ("title:x:y", 1, 1),
    ],
)
def test_grammar(text, filters, taggers):
    q = parse(text)
    assert (len(q.filters), len(q.taggers)) == (filters, taggers)


def test_signs_of_or():
    assert parse("-a OR b").filters[0].negated is False
    assert parse("-a OR -b").filters[0].negated is True
    assert isinstance(parse("a OR b OR c").filters[0].left, Either)


def test_colonless_function_is_text():
    leaf = parse("-ml-model(topics,0.9)").filters[0]
    assert leaf.name == "" and leaf.negated and leaf.arg == "ml-model(topics,0.9)"


@pytest.mark.parametrize("text", ["uri:shop.example/a", "ml-model(topics,0.9):* has:description tag:old lang:fr", 'site:a OR site:b -"x y" lang::*', "regex:a:b", '"title:a b" distinct-window(host):5'])
def test_round_trip(text):
    q = parse(text)
    assert parse(q.text()) == q


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "-b", "site:x", "-title:y", "OR", "and", "lang:en:*", "tag::z", '"q r"', "has:p"]), max_size=8))
def test_any_mix_round_trips_or_fails(parts):
    try:
        q = parse(" ".join(parts))
    except QueryError:
        return
    assert parse(q.text()) == q


@pytest.mark.parametrize("text", ["bogus:x", "OR a", "a OR lang::*", "regex:(", "distinct-window(colour):5", "geo-ip-ll:nowhere"])
def test_errors(spark, text):
    with pytest.raises(QueryError):
        compile_query(text)


def test_cost_order_and_explain(spark):
    e = explain('tion -site:a lang:en title:x "b c" lang::*')
    assert [f.text for f in e.filters] == ["title:x", "tion", '"b c"', "lang:en", "-site:a"]
    assert e.succeeded and e.needs_text and e.needs_result and not e.needs_stream
    assert e.max_cost == 1 + 30 + 30 + 50 + 1000 + 50
    assert not explain("bogus:x").succeeded
    assert {"site", "xpath", "ml-model"} <= {f[0] for f in supported_filters()}


def test_nested_queries(spark):
    ctx = Context(workspaces={f"k{i}": f"query(k{i + 1}):*" for i in range(12)})
    with pytest.raises(QueryError):
        compile_query("query(k0):*", ctx)
    assert compile_query("query(unknown):* a", ctx).parts[0].arg == "a"


def test_stored_results_refuse_text(spark):
    df = spark.createDataFrame([("http://a.b/c",)], "uri string")
    with pytest.raises(QueryError):
        distill(df, "word")
    assert distill(df, "uri:b/c").count() == 1
    assert distill(df, "uri:B/C").count() == 0
    assert distill(df, "").count() == 0
