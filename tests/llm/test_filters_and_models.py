"""URL cascade, decontamination, packing, quality, toxicity, pipeline."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from oracle import SF
from websieve.llm.decontaminate import decontaminate
from websieve.llm.packing import END, PAD, best_fit, pack, pack_group, pack_texts, packed_sequences, plan_of
from websieve.llm.quality import quality
from websieve.llm.toxicity import toxicity
from websieve.llm.url_filter import Bloom, Cascade, build_cascade, filter_urls, split_url


@pytest.mark.parametrize(
    ("url", "parts"),
    [("http://A.b/C?d", ("a.b", "/C")), ("x", ("", "")), (None, ("", "")), ("s://h#/x", ("h", "")), ("//h/p", ("", "")), ("a://b://c/d", ("b:", "//c/d")), ("http://É.x/", ("É.x", "/")), ("://h/", ("h", "/")), ("http://h?/a", ("h", ""))],
)
def test_split_url(url, parts):
    assert split_url(url) == parts


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "a.example.net", "/en/x"), ("allow", "org", "")]


def brute_verdict(url):
    host, path = split_url(url)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[1], max(fits)[2]) if fits else (None, "allow")


def test_urls(spark):
    urls = [None, "", "x", "http://net", "http://net/", "http://a.example.net/en/x1", "http://b.example.net/en/x", "http://EXAMPLE.net/de/", "http://q.org", "http://org/z?/", "http://borg/", "http://a.example.net/en/", "http://example.net/e"] * 3
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, RULES).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert filter_urls(df, []).where("verdict <> 'allow' or rule is not null").count() == 0
    assert filter_urls(df.limit(0), RULES).count() == 0
    with pytest.raises(ValueError):
        filter_urls(df, [("block", "a", "/"), ("allow", "a", "/")])


def test_cascade_is_exact_on_its_universe(spark):
    """Tiny filters with many false positives, so that several levels are needed."""
    hosts = [f"h{i}.example" for i in range(3000)]
    pages = spark.createDataFrame([(f"http://{h}/",) for h in hosts], "url string")
    listed = [f"h{i}.example/" for i in range(0, 3000, 3)]
    cascade = build_cascade(pages, "url", listed, [1], bits_per_key=2.0, max_bits=1 << 20)
    assert len(cascade.levels) >= 4
    assert [h for h in hosts if (f"{h}/" in cascade) != (f"{h}/" in set(listed))] == []
    assert "x" not in Cascade([Bloom(1, 0, 10)])


def brute_contamination(text, items, window=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, found = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        n = min(window, len(iw))
        for s in range(len(iw) - n + 1 if iw else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[s : s + n]:
                    hit.update(range(p, p + n))
                    found.add(str(name))
    names = sorted(found)
    return len(w), len(hit), names, hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_words", [1_000_000, 40])
def test_decontamination(spark, docs, block_words):
    rng = random.Random(3)
    word = lambda: rng.choice(["the", "of", "É", "x1", "And", "zz", "q"])
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 30])))) for i in range(20)] + [(90, ""), (91, None), (92, "!!"), (10, "the of"), (93, "rare alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    rows = [(1, None), (2, ""), (3, "?"), (4, "rare-alpha, BETA gamma delta epsilon zeta eta theta iota"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa rare alpha")]
    rows += [(10 + i, " ".join(word() for _ in range(40)) + " " + items[i % 20][1] + " end") for i in range(25)] + [(60, items[4][1] * 400)]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, items string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.items, r.items_sha256, r.contaminated) for r in decontaminate(docs(rows).repartition(3), bench, block_words=block_words).collect()}
    want = {i: brute_contamination(t, items) for i, t in rows}
    assert got == want
    assert decontaminate(docs(rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(docs([]), bench).count() == 0


def test_best_fit_places_everything():
    rng = random.Random(1)
    lengths = sorted((rng.randrange(0, 100) for _ in range(300)), reverse=True)
    for prefer in (None, 40, 100):
        cost, places, sizes = best_fit(lengths, [40, 60, 100], 4, prefer)
        used = [0] * len(sizes)
        for (b, o), n in zip(places, lengths):
            assert o == used[b]
            used[b] += n
        assert all(u <= c for u, c in zip(used, sizes)) and cost == sum(sizes) + 4 * len(sizes)
        assert all(c == 40 or u > {60: 40, 100: 60}[c] for u, c in zip(used, sizes))
    assert best_fit([7, 5, 3], [10], 0, None)[1] == [(0, 0), (1, 0), (0, 7)]


def naive_best_fit(lengths, capacities, overhead, prefer):
    """Open bins as plain lists; every bin is looked at for every length."""
    bins, left = [], sum(lengths)
    for k, n in enumerate(lengths):
        fitting = [b for b in bins if b["size"] - sum(b["has"]) >= n]
        if fitting:
            b = min(fitting, key=lambda b: (b["size"] - sum(b["has"]), -b["filled"]))  # of equal rooms the one filled last
        else:
            can = [c for c in capacities if c >= n]
            c = (prefer if prefer >= n else can[0]) if prefer else min(can, key=lambda c: ((c + overhead) / max(1, min(c, left)), c))
            bins.append(b := {"size": c, "has": []})
        b["has"].append(n)
        b["filled"] = k
        left -= n
    return sum(min(c for c in capacities if c >= sum(b["has"])) + overhead for b in bins)


def cheapest(lengths, capacities, overhead):
    """The least cost over all ways to deal lengths to bins."""
    best = float("inf")

    def deal(k, sums):
        nonlocal best
        if k == len(lengths):
            best = min(best, sum(min(c for c in capacities if c >= s) + overhead for s in sums))
            return
        for b in range(len(sums)):
            if sums[b] + lengths[k] <= max(capacities):
                deal(k + 1, [*sums[:b], sums[b] + lengths[k], *sums[b + 1 :]])
        deal(k + 1, [*sums, lengths[k]])

    deal(0, [])
    return best


def test_best_fit_against_brute_force():
    rng, capacities, exact = random.Random(9), [16, 32, 64], 0
    for case in range(120):
        overhead = rng.choice([0, 1, 9])
        lengths = sorted((rng.randrange(1, 65) for _ in range(rng.randrange(1, 7))), reverse=True)
        costs = [best_fit(lengths, capacities, overhead, p)[0] for p in (None, 64, 32, 16)]
        assert costs == [naive_best_fit(lengths, capacities, overhead, p) for p in (None, 64, 32, 16)]
        places, sizes = pack_group(lengths, capacities, overhead)
        least, got = cheapest(lengths, capacities, overhead), sum(sizes) + overhead * len(sizes)
        assert least <= got == min(costs) <= 1.6 * least
        exact += got == least
    assert exact >= 90


def test_packing_texts(spark, docs):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 30), (1, "again"), (None, "n"), (None, "n"), (5, "x" * 41), (6, "y" * 40), (7, "z" * 9)]
    bins = pack_texts(docs(rows).repartition(3), capacities=(10, 20), overhead=1, group_pieces=6).collect()
    seen = []
    for r in bins:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert len(ids) == r.capacity in (10, 20) and ids[r.bin_used :] == [PAD] * (r.capacity - r.bin_used) and r.bin_used == sum(r.length)
        seen += [(i, p, s, ids[o : o + n]) for i, p, s, n, o in zip(r.doc_id, r.piece, r.start, r.length, r.bin_offset)]
    want = [(i, s // 20, s, x[s : s + 20]) for i, t in rows for x in [[*(t or "").encode(), END]] for s in range(0, len(x), 20)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    assert sorted(seen, key=key) == sorted(want, key=key)
    assert pack_texts(docs([])).count() == 0
    plan = plan_of(pack_texts(docs(rows), capacities=(10, 20), overhead=1)).collect()
    assert {r.bin_sha256 for r in plan} and len(plan) == len(want)


def test_packing(spark):
    rows = [(i, n, "x") for i, n in enumerate([0, None, -3, 1, 10, 11, 25, 10, 4, 3, 3])] + [(3, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, n bigint, bin_id string")
    got = pack(df, df["n"], capacities=(4, 10), overhead=1, group_pieces=5).collect()
    total = {}
    for r in got:
        total.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.capacity in (4, 10) and r.bin_offset + r.length <= r.bin_used <= r.capacity and r.start == r.piece * 10
    assert sorted(total[6]) == [(0, 10), (10, 10), (20, 5)] and total[3] == [(0, 1), (0, 1)] and total[0] == total[1] == total[2] == [(0, 0)]
    assert pack(df.limit(0), df["n"]).count() == 0
    tokens = spark.createDataFrame([(i, list(range(100 * i, 100 * i + max(0, n or 0)))) for i, n, _ in rows[:-1]], "doc_id bigint, ids array<int>")
    plan = pack(df.dropDuplicates(["doc_id"]), df["n"], capacities=(4, 10), overhead=1)
    packed = {r.bin_id: r.ids for r in packed_sequences(tokens, plan, pad=-1).collect()}
    for r in plan.where("length > 0").collect():
        assert packed[r.bin_id][r.bin_offset : r.bin_offset + r.length] == list(range(100 * r.doc_id + r.start, 100 * r.doc_id + r.start + r.length)) and len(packed[r.bin_id]) == r.capacity


def corpus(spark, n=1200):
    rng = random.Random(5)
    plain = [rng.choice("ka lo mi nu re sa ti vo".split()) + rng.choice("ba de fi go hu".split()) + rng.choice(["", "n", "r"]) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        toxic, junk = i % 9 == 0, i % 7 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), "vequ" + rng.choice(["ra", "to", "li", "mo", "ne"]))
        if junk:
            words = [w + " |" if k % 2 else w * 2 for k, w in enumerate(words)]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", None))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(5000, None, None, None, None), (5001, "", "", "", None), (None, "kaba lode", "en", "s1", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, score string").repartition(3)
    return d, spark.createDataFrame([*labels, (1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def accuracy(result, labels, column):
    rows = result.join(labels, "doc_id").where(f"held_out and {column} is not null").select("predicted", column).collect()
    return sum(a == b for a, b in rows) / len(rows)


def test_toxicity(spark):
    d, labels = corpus(spark)
    got = toxicity(d, labels).cache()
    assert got.count() == 1203 and accuracy(got, labels, "toxic") >= 0.97
    rows = got.collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert toxicity(d.limit(0), labels).count() == 0
    assert toxicity(d, labels.limit(0)).count() == 1203


def test_toxicity_ignores_held_out_labels(spark):
    from pyspark.sql import functions as F

    d, labels = corpus(spark, 400)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = lambda y: sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity(d, y).collect())
    assert scores(labels) == scores(turned)


def test_quality(spark):
    d, labels = corpus(spark)
    got = quality(d, labels).cache()
    assert got.count() == 1203 and accuracy(got, labels, "quality") >= 0.97
    assert {r.predicted for r in got.where("doc_id in (5000, 5001)").collect()} == {0}
    assert quality(d.limit(0), labels).count() == 0
    assert quality(d, labels.limit(0)).count() == 1203


def test_pipeline(spark):
    """run() equals its stages one by one, and each stage's decision by brute force."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        left = {r.doc_id: r.text for r in docs.collect()}
        assert left.items() <= before.items()
        if name == "exact dedup":
            first = {}
            for i in sorted(before):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", before[i]), i)
            assert set(left) == set(first.values())
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(left) == {i for i, t in before.items() if not brute_contamination(t, items)[4]}
    packed = p.STAGES[-1][1](spark, docs, SF)
    rows = lambda df: sorted((r.doc_id, r.piece, r.length, r.bin_id, r.bin_offset, r.bin_sha256) for r in plan_of(df).collect())
    assert rows(packed) == rows(p.run(spark, SF))
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert sum(map(sum, (r.length for r in packed.collect()))) == sum(len(t) + 1 for t in texts.values())
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        want = [x for i, s, n in zip(r.doc_id, r.start, r.length) for x in [*texts[i], END][s : s + n]]
        assert ids.tolist() == want + [PAD] * (r.capacity - r.bin_used)
