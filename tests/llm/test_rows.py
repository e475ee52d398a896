"""Repeated and null ids, null and empty texts, clashing columns: each row is judged on its own."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from oracle import SF
from websieve.llm import decontaminate, exact_dedup, line_dedup, near_dedup, quality, simhash, warc

LONG = " ".join(f"w{i}" for i in range(80))
NEAR = LONG.replace("w40", "other")
ROWS = [(1, "a"), (2, "a"), (2, "unique words"), (None, "a"), (3, "z"), (3, "z"), (None, None), (4, ""), (5, LONG), (5, NEAR), (None, LONG), (6, "q"), (None, "own"), (None, "own")]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, FP int, text_view int, row_key int, text_sha256 string, label int, gone_id int, spread int, again int, _id int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, None, -1, 7, 7, 7, "x", 7, 7, 7, 7, 7) for i, t in rows], COLUMNS).repartition(3)


def left(df):
    assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")] and all(r.label == r.spread == 7 for r in df.collect())
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("winners", [1, 256])
def test_exact(spark, winners):
    want = Counter([(1, "a"), (2, "unique words"), (3, "z"), (4, ""), (5, LONG), (5, NEAR), (6, "q"), (None, "own")])
    assert left(exact_dedup.drop_copies(make(spark, ROWS), winners=winners, tracked=1024)) == want
    assert left(exact_dedup.drop_copies(make(spark, []))) == Counter()


def test_near(spark):
    got = left(near_dedup.drop_near_copies(make(spark, ROWS)))
    five = [k for k in got if k[0] == 5]
    assert len(five) == 1 and got == Counter([(1, "a"), (2, "unique words"), (3, "z"), (4, ""), (6, "q"), (None, "own"), *five])
    assert left(near_dedup.drop_near_copies(make(spark, []))) == Counter()


def test_simhash(spark):
    got = left(simhash.drop_near_copies(make(spark, ROWS), radius=0))
    assert got == Counter([(1, "a"), (2, "unique words"), (3, "z"), (4, ""), (5, LONG), (5, NEAR), (6, "q"), (None, "own")])
    assert left(simhash.drop_near_copies(make(spark, []))) == Counter()


@pytest.mark.parametrize("block_words", [10**6, 3])
def test_contaminated(spark, block_words):
    items = spark.createDataFrame([(1, "z"), (2, LONG), (3, "unique words here"), (4, None)], "item_id int, text string")
    got = left(decontaminate.drop_contaminated(make(spark, ROWS), items, block_words=block_words))
    want = Counter(ROWS)
    for gone in ((3, "z"), (5, LONG), (5, NEAR), (None, LONG)):
        del want[gone]
    assert got == want
    assert left(decontaminate.drop_contaminated(make(spark, ROWS), items.limit(0))) == Counter(ROWS)


def test_poor(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 60)] + [(2, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    rows = [(i, f"good words number {i} and so on" if i % 2 else "| | | ## |") for i in range(10, 60)] + [(2, "| ## | |"), (2, "good words number and so on"), (None, "| | ## |"), (None, "good words number and so on"), (None, None)]
    assert left(quality.drop_poor(make(spark, rows), labels)) == Counter(r for r in rows if r[1] and "good" in r[1])
    one_class = labels.where("quality = 0")
    assert left(quality.drop_poor(make(spark, rows), one_class)) == left(quality.drop_poor(make(spark, rows), labels.limit(0))) == Counter(rows)
    assert left(quality.drop_poor(make(spark, []), labels)) == Counter()


def test_lines(spark):
    hot = "a line of over forty characters that documents share"
    rows = [(i, f"{hot}\nown {i}") for i in range(10, 18)] + [(2, f"{hot}\nrest"), (2, "precious\nother"), (2, "precious\nother"), (None, hot), (None, hot)]
    got = line_dedup.line_dedup(make(spark, rows)).collect()
    want = [(i, f"own {i}", 1) for i in range(10, 17)] + [(17, f"{hot}\nown 17", 0), (2, "rest", 1), (2, "precious\nother", 0), (2, "precious\nother", 0), (None, hot, 0), (None, hot, 0)]
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in got) == Counter(want)


def test_warc(spark):
    a, b, tiny = "a" * 200, "b" * 300, "t"
    rows = [(1, a), (7, a), (7, a), (7, b), (8, b), (None, a), (None, a), (9, tiny), (9, tiny), (9, None), (10, "c" * 70_000)]
    pages = spark.createDataFrame([(i, None, h, "x", 1) for i, h in rows], "page_id bigint, url string, html string, digest string, spread int").repartition(3)
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = Counter((i, len(h or ""), sha(h), "response", None) for i, h in rows)
    for i, h, first in ((7, a, 1), (8, b, 7)):
        want[(i, len(h), sha(h), "revisit", first)] = want.pop((i, len(h), sha(h), "response", None))
    assert Counter(map(tuple, warc.warc_round_trip(pages).collect())) == want


def test_every_stage_takes_odd_rows(spark):
    from corpus_pipeline import STAGES

    for rows in (ROWS, []):
        docs = make(spark, rows)
        for _, stage in STAGES[:-1]:
            kept = left(stage(spark, docs, SF))
            assert kept <= Counter(rows)
        packed = STAGES[-1][1](spark, docs, SF)
        assert sum(sum(r.length) for r in packed.collect()) == sum(len(t or "") + 1 for _, t in rows)
