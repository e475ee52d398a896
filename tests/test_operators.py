"""Windows, hashes, links, HTML, content, packets, store, frontier, profiles, streams."""

from __future__ import annotations

import gzip
from collections import deque

import pytest
from pyspark.sql import functions as F

from websieve.config import Settings
from websieve.errors import InvalidRequest, NotFound, PermissionDenied, RevisionConflict
from websieve.functions import content, scalars, urls
from websieve.functions.hashing import HashRange, try_md5
from websieve.functions.html import keywords, page_view, xpath_found
from websieve.functions.language import detect
from websieve.operators import frontier, geo, store, windows
from websieve.operators.windows import RecentValues
from websieve.sources import blobs, packets


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


# windows


def test_recent_values():
    r = RecentValues(10)
    assert [r.add(c) for c in "ABCDEFGHIJ"] == [None] * 10
    assert r.add("K") == "A" and "A" not in r and "B" in r and "K" in r


def test_recent_values_forgets_newer_copies():
    r = RecentValues(2)
    r.add("A"), r.add("A"), r.add("B")
    assert "A" not in r and "B" in r


def brute_window(values, n):
    seen, out = deque(maxlen=n), []
    for i, v in enumerate(values):
        if v not in seen:
            out.append(i)
            seen.append(v)
    return out


@pytest.mark.parametrize("n", [1, 3, 7, 1000])
def test_distinct_window(spark, n):
    values = [(i * i * 7 + i // 3) % 11 for i in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "seq bigint, v bigint").repartition(5)
    got = sorted(r.seq for r in windows.distinct_window(df, F.col("v"), n).collect())
    assert got == brute_window(values, n)
    rest = sorted(r.seq for r in windows.distinct_window(df, F.col("v"), n, exclude=True).collect())
    assert rest == [i for i in range(300) if i not in set(got)]


def test_suppression(spark):
    from websieve.plans.compiler import Context, compile_query

    rows = [(i, f"{'same context' if i % 2 else f'context {i}'} word {'same' if i % 2 else i}") for i in range(10)]
    df = spark.createDataFrame(rows, "seq bigint, eval_text string")
    got = sorted(r.seq for r in compile_query("WORD", Context(suppress_repeats=True)).apply(df).collect())
    assert got == [0, 1, 2, 4, 6, 8]


def test_balanced_sample(spark):
    df = spark.createDataFrame([(i, "abc"[0 if i < 20 else 1 if i < 25 else 2]) for i in range(26)], "id bigint, c string")
    got = windows.balanced_sample(df, "c", F.col("id"), minimum=1).groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {"a": 5, "b": 5}


# hashes


def test_hash_ranges():
    halves = HashRange().split([0.5, 0.5])
    assert halves == [HashRange("0" * 32, "7" + "f" * 31), HashRange("8" + "0" * 31, "f" * 32)]
    assert halves[0].coverage() == 0.5 and halves[0].most in halves[0] and halves[1].least not in halves[0]
    with pytest.raises(InvalidRequest):
        HashRange().split([0.5, 0.4])
    assert try_md5("0B1DBE29DBED4AFC1196CC430FD370C1") and try_md5("x") is None


def test_known_md5(spark):
    assert one(spark, F.md5(F.lit("http://en.wikipedia.org/robots.txt").cast("binary")).alias("h")).h.upper() == "0B1DBE29DBED4AFC1196CC430FD370C1"


# links and pages


@pytest.mark.parametrize(
    ("candidate", "found"),
    [
        ("https://www.shop.example", ["https://www.shop.example/"]), ("#x", []), ("mailto:a@b.c", []), ("//h.org/p", ["http://h.org/p"]), ("/p", ["http://a.org/p"]), ("p", ["http://a.org/d/p"]),
        ("http:///h.com", ["http://h.com/"]), ("http://a.com/?u=http://b.com", ["http://a.com/?u=http://b.com", "http://b.com/"]), ("http://a.com/" + "x" * 2043, []), ("http://nodot/", []), ("q#frag", ["http://a.org/d/q"]), ("", []),
    ],
)
def test_resolve(candidate, found):
    assert urls.resolve("http://a.org/d/page.html", candidate) == found
    assert urls.resolve(None, candidate) == []


def test_finding_links():
    assert [x for _, x in urls.text_links("http://a.org/", "see https://www.mill.example/ and <a href=\"https://www.shop.example\"> <a href='https://www.shop.example'>")] == ["https://www.mill.example/", "https://www.shop.example/", "https://www.shop.example/"]
    page = "<base href='http://b.org/x/'><a href=y>1</a><script src='/s.js'></script><link href='l.css'>"
    assert list(urls.html_links("http://a.org/", page)) == [("a", "http://b.org/x/y"), ("script", "http://b.org/s.js"), ("link", "http://b.org/x/l.css")]


def test_page_view():
    v = page_view("<html><title> A &amp;  B </title><h1>H</h1><meta property='og:type' content=x><meta property='og:type' content=y><meta name=description content=' d  e '><p>one<br>two <b>three</b></p><script>no</script><!-- no -->")
    assert v["title"] == "A & B" and v["description"] == "d e" and v["props"] == {"og_type": "x"}
    assert v["fragments"] == [("title", "A & B"), ("h1", "H"), ("p", "one"), ("p", "two"), ("b", "three")]
    assert "A" not in v["eval_text"] and "three" in v["eval_text"] and "no" not in v["eval_text"].split()
    assert page_view("<h2>x</h2><title>t</title>")["title"] == "x"
    assert page_view("<title>t</title><meta property='og:title' content='o'>")["title"] == "o"
    assert len(page_view(f"<title>{'x' * 500}</title>")["title"]) == 128
    assert page_view("")["title"] is None and page_view("<title>open")["title"] == "open"
    assert keywords("<p>ab</p><!-- cd --><i>e</i>", 2) == ["ab", "cd"]


@pytest.mark.parametrize(("expression", "hit"), [("//p", True), ("//p/b", True), ("//a[@href='x']", True), ("//table", False), ("//p[", False), ("//a/@href", True), ("//p/@href", False)])
def test_xpath(expression, hit):
    assert xpath_found("<div><p>a<br><b>c</b><a href=x>d</div>", expression) is hit


@pytest.mark.parametrize(("text", "code"), [("the cat is on the mat and of it", "en"), ("le chat est dans la maison et les", "fr"), ("der Hund und die Katze sind nicht für", "de"), ("el perro y la casa de los niños", "es"), ("", None), ("xyzzy", None)])
def test_language(text, code):
    assert detect(text) == code


# content


def test_content_types(spark):
    row = lambda raw: one(spark, content.content_type(F.lit(raw)).alias("c"), content.content_type_text(content.content_type(F.lit(raw))).alias("t"), content.content_class(F.lit(raw)).alias("k"))
    assert (row("text/html").c.media, row("text/html").c.sub, row("text/html").k) == ("text", "html", "html")
    r = row("text/html; charset=UTF-8")
    assert r.c.attrs == {"charset": "UTF-8"} and r.t == "text/html; charset=UTF-8"
    assert (row("text").c.sub, row("/html").c.media, row("").k) == ("", "", "unknown")
    guess = lambda b: one(spark, content.guess_type(F.lit(bytearray(b))).alias("g")).g
    assert guess(b"") == "application/x-empty" and guess(b" <!DOCTYPE html><p>") == "text/html" and guess(b"%PDF-1") == "application/pdf" and guess(b"a\x00") == "application/octet-stream"


def test_headers_and_blocks(spark):
    h = one(spark, content.headers(F.lit("content-type:\nX: a:b\nx: c\nnone")).alias("h")).h
    assert h == {"content-type": "", "x": "a:b"}
    block = lambda n, k, v: one(spark, content.block_reason(F.lit(n), F.create_map(F.lit(k), F.lit(v))).alias("r")).r
    assert block(2_000_000, "a", "b").startswith("length") and block(1, "content-type", "image/png") == "content type image/png"
    assert block(1, "rating", content.ADULT_RATING) == "adult rating" and block(1, "content-type", "text/html") is None


def test_scalars(spark):
    s = F.lit
    r = one(
        spark, scalars.make_tag(s(" New York ")).alias("tag"), scalars.wildcard(s("a.c"), "a?c").alias("w"), scalars.wildcard(s("abc"), "a.c").alias("x"), scalars.reduce_whitespace(s(" a \n b ")).alias("r"),
        scalars.pad_left(F.array(s(1)), 3, 0).alias("l"), scalars.pad_right(F.array(s(1)), 3, 0).alias("p"), scalars.constrain(s(7), 1, 5).alias("c"), scalars.any_flag(s(6), 2).alias("f"), scalars.fragment(s("0123456789"), s(5), s(1), 2).alias("g"),
        scalars.ip_number(s("1.2.3.4")).alias("ip"), scalars.ip_number(s("x")).alias("bad"), scalars.words(s("a1b, çd!")).alias("ws"), scalars.text_tags(s("a  b")).alias("tt"), scalars.private_address(s("192.168.1.1")).alias("pa"),
    )
    assert (r.tag, r.w, r.x, r.r, r.l, r.p, r.c, r.f) == ("New_York", True, False, "a b", [0, 0, 1], [1, 0, 0], 5, True)
    assert (r.g, r.ip, r.bad, r.ws, r.tt, r.pa) == ("23456", 16909060, None, ["a", "b", "çd"], ["a", "b"], True)


# packets


RESOURCE = "<resource><request>Uri: http://a.org/{0}\nReferer: r\n</request><response><header>Content-Type: text/html\n</header><data>PHA+aGk8L3A+</data></response></resource>"


def packet(n):
    bad = "<resource><request>Uri: http://b.org/\n</request><exception>System.TimeoutException: x</exception></resource>"
    return ("<?xml version='1.0'?><resources><startTime>t</startTime>" + "".join(RESOURCE.format(i) for i in range(n)) + bad + "<endTime>t</endTime></resources>").encode()


def test_packets(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "packet-1.xml").write_bytes(gzip.compress(packet(2)))
    (tmp_path / "sub/packet-2.xml.gz").write_bytes(gzip.compress(packet(3)))
    (tmp_path / "packet-3.xml").write_bytes(packet(1))
    (tmp_path / "packet-4.xml").write_bytes(packet(2)[:-200])
    (tmp_path / "packet-5.xml").write_bytes(gzip.compress(packet(4))[:-30])
    df = packets.read_packets(spark, str(tmp_path), keep_errors=True).cache()
    by = {r.f: (r.n, r.bad) for r in df.groupBy(F.element_at(F.split("file", "/"), -1).alias("f")).agg(F.count_if(F.col("error").isNull()).alias("n"), F.count("error").alias("bad")).collect()}
    assert by["packet-1.xml"] == (3, 0) and by["packet-2.xml.gz"] == (4, 0) and by["packet-3.xml"] == (2, 0)
    assert by["packet-4.xml"][0] >= 1 and by["packet-4.xml"][1] == 1 and by["packet-5.xml"][1] == 1
    assert {bytes(r.data) for r in df.where("data is not null").select("data").collect()} == {b"<p>hi</p>"}
    out = str(tmp_path / "out")
    packets.write_packets(packets.read_packets(spark, str(tmp_path / "packet-3.xml")), out, per_packet=1)
    again = packets.read_packets(spark, out, glob="*.gz")
    assert again.count() == 2 and again.where("data is not null").count() == 1
    assert packets.read_plain_packets(spark, str(tmp_path / "packet-3.xml")).count() == 2


def test_blobs(spark, tmp_path):
    d = spark.createDataFrame([(bytearray(b"<p>x</p>"),), (bytearray(b"<p>x</p>"),), (None,)], "data binary")
    path = str(tmp_path / "blobs")
    blobs.put_blobs(path, d)
    blobs.put_blobs(path, d)
    stored = spark.read.parquet(path)
    assert stored.count() == 1
    assert [r.text for r in blobs.page_text(stored, stored.first().data_hash).collect()] == ["x"]


# store


def results(spark):
    rows = [("a", f"h{i}", f"http://s{i % 2}.org/{i}", i, ["t"] if i % 2 else []) for i in range(6)] + [("b", "h1", "http://old.org", 100, ["keep"])]
    return spark.createDataFrame(rows, "workspace_id string, uri_hash string, uri string, sequence bigint, tags array<string>")


def rows_of(df):
    return sorted((r.workspace_id, r.uri_hash, tuple(r.tags)) for r in df.collect())


def test_transforms(spark):
    s = results(spark)
    go = lambda action, **k: store.transform(s, store.Transform(action, "a", **k))
    keys = s.where("sequence in (0, 1)").select("uri_hash")
    moved, n = go("move_specific", hashes=keys, target="b")
    assert n == 2 and ("b", "h0", ()) in rows_of(moved) and ("b", "h1", ("keep",)) in rows_of(moved) and moved.count() == 6
    copied, _ = go("copy_all", target="b")
    assert copied.count() == 12 and ("b", "h1", ("keep",)) in rows_of(copied)
    tagged, n = go("tag_query", query="site:s1", tag="t")
    assert n == 3 and rows_of(tagged) == rows_of(s)
    assert [t for _, h, t in rows_of(go("untag_all", tag="t")[0]) if h == "h3"] == [()]
    assert go("delete_query", query="site:s0")[0].count() == 4 and go("delete_all")[0].count() == 1
    for bad in (("move_all", {}), ("tag_all", {}), ("delete_query", {}), ("delete_specific", {}), ("fly", {})):
        with pytest.raises(InvalidRequest):
            go(bad[0], **bad[1])
    with pytest.raises(InvalidRequest):
        go("delete_query", query="word")


def test_listing_limits(spark):
    s = results(spark)
    for bad in ({"offset": -1}, {"count": 0}, {"count": 1001}, {"order": "title"}):
        with pytest.raises(InvalidRequest):
            store.list_results(s, "a", **bad)
    page = store.list_results(s, "a", order="sequence:desc", offset=2, count=2)
    assert [r.sequence for r in page.results.collect()] == [3, 2] and (page.total, page.subset, page.page) == (6, 6, 1)


def test_service(spark):
    from websieve.api import Engine

    empty = results(spark).limit(0).withColumn("data_hash", F.lit("x")).withColumn("created", F.current_timestamp()).withColumn("updated", F.current_timestamp())
    e = Engine(spark, empty, spark.createDataFrame([], "data_hash string, data binary"))
    with pytest.raises(InvalidRequest):
        e.create_account("short")
    e.create_account("a-long-enough-name")
    key = e.create_key("a-long-enough-name", "mine", "site:s1")
    rows = results(spark).where("workspace_id = 'a'").drop("workspace_id").withColumn("data_hash", F.lit("x"))
    e.post_results(key.key_id, rows)
    assert e.list_results(key.key_id).total == 6
    assert e.transform(key.key_id, "tag_query", query="site:s1", tag="n") == 3
    reader = e.share_key(key.key_id, "a-long-enough-name", store.READ)
    with pytest.raises(PermissionDenied):
        e.transform(reader.key_id, "delete_all")
    assert e.update_workspace(key.key_id, 0, query_text="x").revision == 1
    with pytest.raises(RevisionConflict):
        e.update_workspace(key.key_id, 0, name="y")
    with pytest.raises(NotFound):
        e.blob("nothing")
    e.put_blobs(spark.createDataFrame([(bytearray(b"z"),)], "data binary"))
    assert e.blob("fbade9e36a3f36d3d676c1b808451dd7") == b"z"
    assert e.register_server("s") == e.register_server("s") == e.server("s")
    assert e.parse("a b").succeeded and e.supported_filters()


# frontier


def test_robots(spark):
    text = "User-agent: *\nDisallow: /cart/*\nDisallow: /map/$\nDisallow: /tmp\nDisallow: /x*old.html$\nSitemap: http://m/s.xml\nUser-agent: named\nDisallow: /feed/9"
    files = spark.createDataFrame([("a.org", text)], "host string, text string")
    rules = frontier.robots_rules(files)
    assert [r.uri for r in frontier.sitemaps(rules).collect()] == ["http://m/s.xml"]
    blocked = ["/tmp", "/cart/list", "/x/very-old.html", "/map/"]
    free = ["/map/1.html", "/x/old.htm", "/"]
    links = spark.createDataFrame([(f"http://a.org{p}",) for p in blocked + free] + [("http://b.org/tmp",)], "target_uri string")
    got = {r.target_uri.removeprefix("http://a.org"): r.blocked_by_robots for r in frontier.blocked_by_robots(links, rules, "me").collect()}
    assert [p for p in blocked if not got[p]] == [] and [p for p in free if got[p]] == [] and got["http://b.org/tmp"] is False
    named = spark.createDataFrame([("http://a.org/feed/weekly-90210",), ("http://a.org/feed/9z",), ("http://a.org/tmp",)], "target_uri string")
    assert [r.blocked_by_robots for r in frontier.blocked_by_robots(named, rules, "Named").orderBy(F.length("target_uri").desc()).collect()] == [False, True, False]
    assert frontier.rule_regex("/x*old.html$") == r"^/x.*old\.html$"


def test_links_codec(spark):
    df = spark.createDataFrame([(None, "http://a.org/x", "1.2.3.4", True)], "source_uri string, target_uri string, target_ip string, can_be_discarded boolean")
    df = frontier.with_chunk_sequence(frontier.with_priority(frontier.early_flags(df).withColumn("visited_recently", F.lit(True))))
    back = frontier.decode_links(frontier.encode_links(df)).first()
    assert back.target_uri == "http://a.org/x" and back.source_uri is None and back.visited_recently and back.target_ip == "1.2.3.4"
    junk = spark.createDataFrame([("a\tb",), ("V\tx\ty\tz\tw",), ("",)], "value string")
    assert frontier.decode_links(junk).count() == 0


def test_decide(spark):
    df = spark.createDataFrame(
        [(1, "http://a.org/", True, 1, 0, False, 0, False), (2, "http://a.org/", True, 800_000_000, 0, False, 0, False), (3, "http://a.org/", True, 1, 2001, False, 0, False), (4, "http://a.org/", True, 1, 0, True, 0, False),
         (5, "http://a.org/", True, 1, 0, False, 4, False), (6, "http://a.org/", True, 1, 0, False, 0, True), (7, None, False, 1, 0, False, 0, False), (8, "http://a.org/", False, 800_000_000, 2001, True, 0, False)],
        "id int, target_uri string, can_be_discarded boolean, priority bigint, chunk_sequence int, ip_seen_recently boolean, host_issues int, blocked_by_robots boolean",
    )
    assert {r.id: r.reason for r in frontier.decide(df).collect()} == {1: None, 2: "priority", 3: "chunk", 4: "early", 5: "network", 6: "robots", 7: "malformed", 8: None}


@pytest.mark.parametrize(("quota", "over"), [(0, [1, 2, 3]), (2, [3]), (3, []), (9, [])])
def test_quota(spark, quota, over):
    df = spark.createDataFrame([(i, f"http://a.org/{i}", False, 10 * i, 0) for i in (1, 2, 3)], "id int, target_uri string, can_be_discarded boolean, priority bigint, chunk_sequence int")
    assert sorted(r.id for r in frontier.decide(df, quota_left=quota).where("reason = 'quota'").collect()) == over


def test_visited(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    links = spark.createDataFrame([("x",), ("y",), ("z",)], "target_hash string")
    visited = spark.createDataFrame([("x", "2025-01-01"), ("y", "2023-01-01")], "uri_hash string, next_fetch string").withColumn("next_fetch", F.col("next_fetch").cast("timestamp"))
    assert sorted(r.target_hash for r in frontier.needs_visiting(links, visited, now).collect()) == ["y", "z"]


def test_geo_join_has_no_nested_loop(spark):
    df = spark.createDataFrame([("1.2.3.4",), (None,), ("300.1",)], "ip string")
    r = spark.createDataFrame([(0, 1 << 26, "c", "d", "e", 1.0, 2.0)], "ip_from bigint, ip_to bigint, city string, country string, subdivision string, lat double, lon double")
    out = geo.with_geo(df, r)
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    assert {x.ip: x.geo.city if x.geo else None for x in out.collect()} == {"1.2.3.4": "c", None: None, "300.1": None}


def test_settings():
    s = Settings().with_value("links_per_page", "7")
    assert s.links_per_page == 7 and ("links_per_page", "7") in s.listing()
    for bad in (("nothing", "1"), ("links_per_page", "x")):
        with pytest.raises(InvalidRequest):
            s.with_value(*bad)


# streams


def test_standing_stream(spark, tmp_path):
    from websieve.sources.pages import build_pages
    from websieve.streaming.standing import RESOURCE as SCHEMA
    from websieve.streaming.standing import StandingStream, tail_packets

    source = str(tmp_path / "in")
    rows = [(i, f"http://h{i % 3}.org/{i}", {}, {"content-type": "text/html"}, bytearray(b"<title>t</title><p>hello")) for i in range(9)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(source)
    loads, got = [], []

    def load():
        loads.append(1)
        return {"w1": "hello site:h1", "w2": "nothing", "w3": ""}

    stream = StandingStream(load, lambda df, n: got.extend((r.workspace_id, r.seq) for r in df.collect()), build_pages, Settings(query_budget_ms=1e9))
    query = stream.start(tail_packets(spark, source, files_per_batch=1), str(tmp_path / "cp"), available_now=True)
    query.awaitTermination(120)
    assert sorted(got) == [("w1", 1), ("w1", 4), ("w1", 7)]
    assert len(loads) == stream.batches == 3 and stream.stats["w1"].included == 3 and stream.stats["w2"].excluded == 9


def test_streaming_windows(spark, tmp_path):
    from websieve.streaming.stateful import distinct_window_stream

    source, values = str(tmp_path / "in"), [1, 2, 1, 3, 1, 2, 2]
    spark.createDataFrame(list(enumerate(values)), "seq bigint, v bigint").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("seq bigint, v bigint").parquet(source)
    q = distinct_window_stream(stream, "v", "seq", 2).writeStream.format("memory").queryName("dw").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.seq for r in spark.table("dw").collect()) == brute_window(values, 2)


def test_budget(spark):
    from websieve.operators.standing import Standing, Stats

    slow = Stats()
    slow.add(1, 0, 500.0)
    s = Standing({"a": "x", "b": "xpath://p", "c": "site:y"}, stats={"a": slow})
    assert s.ordered() == ["c", "b", "a"] and s.ordered(100.0) == ["c", "b"]
