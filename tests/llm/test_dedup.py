"""Exact, line and near dedup against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle import SF
from websieve.llm.components import components
from websieve.llm.exact_dedup import drop_copies, exact_dedup
from websieve.llm.line_dedup import line_dedup
from websieve.llm.simhash import drop_near_copies, fingerprint, links, segments, simhash_dedup

EDGES = [(1, None), (2, ""), (3, "a b"), (4, "a \t\n b"), (5, "a b"), (6, "a b"), (7, "z" * 50_000), (8, "A b"), (9, " a b")]


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    return {i: (min(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


@pytest.mark.parametrize("winners", [1, 256])
def test_exact(docs, winners):
    rows = EDGES + [(100 + i, "hot text") for i in range(200)] + [(400 + i, f"own {i}") for i in range(50)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup(docs(rows).repartition(3), winners=winners, tracked=1024).collect()}
    assert got == brute_exact(rows)


def test_exact_edges(docs):
    assert exact_dedup(docs([])).count() == 0
    got = exact_dedup(docs([(None, "a"), (3, "a"), (None, "b"), (None, "b")])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [("3", "3", 2, True), ("None", "3", 2, False), ("None", "None", 2, True), ("None", "None", 2, True)]
    kept = drop_copies(docs(EDGES))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 7, 8, 9] and kept.columns[0] == "doc_id" and len(kept.columns) == 5


def test_exact_is_native(docs):
    plan = exact_dedup(docs(EDGES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_lines(rows, least=40, many=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    lost = {k: max(ids) for k, ids in holders.items() if len(ids) >= many}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if lost.get(key(x), i) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_lines(docs):
    hot, edge, short = "Éa hot line that very many documents share today", "é" * 40, "x" * 39
    rows = [(1, None), (2, ""), (3, "\n\n")] + [(10 + i, f"own {i}\n  {hot.upper() if i % 2 else hot}\t\n{edge}\n{short}\n{hot}") for i in range(8)] + [(50, f"{hot}\r\nend\n"), (51, edge.upper())]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup(docs(rows).repartition(3)).collect()}
    assert got == brute_lines(rows)
    assert line_dedup(docs([])).count() == 0
    assert line_dedup(docs([(None, hot)] * 9)).where("n_dropped > 0").count() == 0


def brute_fingerprint(text, k=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="aBÉ \n\t\x0b\u00a0z", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode(), 4) == brute_fingerprint(text)


def brute_components(fps, radius=4):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_simhash(spark, docs):
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "q " * 30_000)]
    for k in range(12):
        own = list(words)
        for j in range(k % 4):
            own[37 * (j + k) % 400] = f"edit{k}{j}"
        rows.append((20 + k, " ".join(own)))
    rows += [(100 + i, " ".join(f"r{i}x{j}" for j in range(20))) for i in range(30)]
    got = {r.doc_id: r for r in simhash_dedup(docs(rows).repartition(3)).collect()}
    fps = {i: brute_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == brute_components(fps)
    assert all(r.n_links == sum(0 < (f ^ int(r.fingerprint, 16)).bit_count() <= 4 for f in set(fps.values())) for r in got.values())
    assert simhash_dedup(docs([])).count() == 0
    left = sorted(r.doc_id for r in drop_near_copies(docs(rows)).collect())
    assert left == sorted(set(brute_components(fps).values()))


def test_simhash_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: brute_fingerprint(r.text) for r in d.collect()}
    assert {r.doc_id: r.component_id for r in simhash_dedup(d).collect()} == brute_components(fps)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 5])
def test_segments_cover_open_bits(radius):
    for mask in (0, 0xFF, 0x0F0F << 20):
        s = segments(mask, radius)
        assert len(s) == radius // 2 + 1 and sum(s) == mask ^ (1 << 64) - 1 and max(map(int.bit_count, s)) - min(map(int.bit_count, s)) <= 1


signed = lambda x: x - (1 << 64) if x >> 63 else x


def found_links(spark, fps, radius=4, **kw):
    """(links of each fingerprint, the least fingerprint reachable), from the table of links."""
    table = links(spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3), radius, **kw)
    counts, near = defaultdict(int), defaultdict(set)
    for r in table.collect():
        counts[r.fp % 2**64] += r.n
        near[r.fp % 2**64].add(r.root % 2**64)
        near[r.root % 2**64].add(r.fp % 2**64)
    root = {}
    for f in sorted(fps):
        todo = [] if f in root else [f]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = f
                todo += near[x]
    return counts, root


@pytest.mark.parametrize(("radius", "bucket", "apart"), [(4, 1 << 14, 5), (4, 40, 30), (3, 20, 40), (5, 90, 40)])
def test_links_are_complete(spark, radius, bucket, apart):
    """A dense ball of fingerprints; small buckets pass their members on to further levels."""
    base = 0x9123456789ABCDEF
    fps = {base} | {base ^ 1 << a ^ 1 << b for a in range(0, 64, apart) for b in range(64)} | {base ^ 0b1111, base ^ 0b11111, base ^ 7 << 40}
    fps = sorted(fps | {f ^ 0xFFFF << 30 for f in list(fps)[::7]})
    counts, root = found_links(spark, fps, radius, bucket=bucket)
    assert {f: counts[f] for f in fps} == {f: sum(0 < (f ^ g).bit_count() <= radius for g in fps) for f in fps}
    assert root == brute_components({f: f for f in fps}, radius)


def test_large_group_of_near_copies(spark, docs):
    """20,000 copies of a text with a word changed: no more links than signatures, components as by all pairs."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 60], f"own{i}", *words[i % 60 + 1 :]])) for i in range(20_000)]
    d = docs(rows).repartition(4)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id, r.n_links) for r in simhash_dedup(d).collect()}
    fps, inverse = np.unique(np.array([got[i][0] for i, _ in rows], np.uint64), return_inverse=True)
    assert len(fps) > 15_000
    label, n_links = np.arange(len(fps)), np.zeros(len(fps), int)
    for k in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 4)
        n_links[k] = len(near) - 1
        label[np.isin(label, label[near])] = label[near].min()
    least = np.full(len(fps), len(rows))
    np.minimum.at(least, label[inverse], np.arange(len(rows)))
    assert {i: (c, n) for i, (_, c, n) in got.items()} == {i: (least[label[k]], n_links[k]) for i, k in enumerate(inverse)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loops = [(5, 5), (None, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain + star + loops, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)} | {2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
