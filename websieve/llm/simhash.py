"""SimHash near-dedup through deletion-variant signatures.

Two fingerprints within k bits, cut into k // 2 + 1 segments, have a segment in which they
differ by at most one bit. So each distinct fingerprint is indexed, for each segment, under
the variants of that segment with one bit made a wildcard; fingerprints that share a variant
meet in a bucket by equality and are verified there. A pair is accepted only under its first
such segment and at the differing bit (the segment's lowest bit if there is none), so each
link is found once.

Copies are merged into one row per fingerprint, with partial minima, before anything is
indexed. A bucket's links never leave its task as pairs: a fingerprint comes out once per
bucket, with the least fingerprint that the bucket's links lead to and the number of its
links, so the result is at most a row per signature however dense a group of near copies is.
A bucket of more than ``bucket`` members is passed on, and its members are indexed again under
variants of the bits that the bucket leaves open, which loses no pair. Each of at most
``levels`` levels fixes about a third of them; the last leaves 2^22 members possible.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import components
from .tables import fresh_name, keyed, map_batches, one_of_each, staged, text_bytes

BITS, SEED, CHUNK = 64, 42, 1 << 16
#: Members of a bucket up to which its rows are compared by their distance in the sorted order;
#: pairs that are held at once beyond that.
SMALL, HELD = 16, 1 << 20
FOUND = "fp long, root long, n long, path long"


def fingerprint(text: bytes, shingle: int) -> int:
    """A bit is 1 if over half the shingles' hashes have it; 0 for a text without words.

    bytes.lower and bytes.split know ASCII only, which is what the words are defined by.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, stops = ([0, *ends], ends[shingle - 1 :]) if len(words) > shingle else ([0], ends[-1:])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, stops)], "<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4) -> DataFrame:
    """doc_id, fp (a long with the fingerprint's 64 bits)."""
    d = keyed(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(d, run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


def segments(closed: int, radius: int) -> list[int]:
    """The bits outside closed as radius // 2 + 1 masks of neighbours, as even as possible."""
    n, free = radius // 2 + 1, [b for b in range(BITS) if not closed >> b & 1]
    edges = [len(free) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in free[a:b]) for a, b in zip(edges, edges[1:])]


@lru_cache
def paths(level: int, radius: int) -> dict[int, tuple[int, int, tuple]]:
    """Name of a bucket's path -> (bits it fixes, bits of the segments cut so far, its steps).

    The closed bits are the fixed ones and one wildcard for each level, whose numbers are the
    path's name; the next level cuts the others. A step holds the bits fixed before it, its
    segments, and the bits fixed after it.
    """
    if level < 0:
        return {0: (0, 0, ())}
    out = {}
    for name, (fixed, closed, steps) in paths(level - 1, radius).items():
        parts = segments(closed, radius)
        for s in parts:
            for b in range(BITS):
                if s >> b & 1:
                    out[name * BITS + b] = fixed | s ^ 1 << b, closed | s, (*steps, (fixed, *parts, fixed | s ^ 1 << b))
    return out


@lru_cache
def path_table(level: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The paths of a level, rising, and their steps: [level, part of the step, path]."""
    known = paths(level, radius)
    names = sorted(known)
    return np.array(names), np.array([known[k][2] for k in names], np.uint64).transpose(1, 2, 0).copy()


@lru_cache
def variants(path: int, level: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(paths, bits they fix) of a level below a path of the level before."""
    fixed, closed, _ = paths(level - 1, radius)[path]
    own = [(path * BITS + b, fixed | s ^ 1 << b) for s in segments(closed, radius) for b in range(BITS) if s >> b & 1]
    return np.array([k for k, _ in own]), np.array([m for _, m in own], np.uint64)


def accepts(x: np.ndarray, path: np.ndarray, level: int, radius: int) -> np.ndarray:
    """Which pairs with difference x a bucket of that path accepts; one bucket of a level does."""
    names, table = path_table(level, radius)
    at, ok = np.searchsorted(names, path), np.ones(len(x), bool)
    for before, *parts, after in table:
        chosen, open_ = np.zeros(len(x), np.uint64), np.ones(len(x), bool)
        for s in parts:
            s = s[at]
            part = x & s
            here = open_ & (np.bitwise_count(part) <= 1)
            bit = np.where(part == 0, s & (~s + np.uint64(1)), part)
            chosen = np.where(here, (before[at] | s) ^ bit, chosen)
            open_ &= ~here
        ok &= chosen == after[at]
    return ok


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j; label is each place's least place, before and after."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def linked(fp: np.ndarray, path: np.ndarray, start: np.ndarray, level: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(least place linked to, links) of each place; buckets begin at ``start``, the last is an end."""
    label, links = np.arange(len(fp)), np.zeros(len(fp), np.int64)
    size = np.diff(start)
    left = np.repeat(start[1:], size) - np.arange(len(fp)) - 1  # members of its bucket after each place

    def accepted(i, j):
        x = fp[i] ^ fp[j]
        near = np.flatnonzero(np.bitwise_count(x) <= radius)
        own = near[accepts(x[near], path[i[near]], level, radius)]
        for k in (i[own], j[own]):
            np.add.at(links, k, 1)
        return i[own], j[own]

    some = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for step in range(1, SMALL):
        some = some[left[some] >= step]
        join_labels(label, *accepted(some, some + step))
    for a, b in zip(*(e[size > SMALL].tolist() for e in (start[:-1], start[1:]))):
        own, rows = np.arange(b - a), max(1, HELD // (b - a))
        for k in range(a, b, rows):
            near = np.bitwise_count(fp[k : min(b, k + rows), None] ^ fp[None, k:b]) <= radius
            i, j = accepted(*(p + k for p in np.nonzero(np.triu(near, 1))))
            join_labels(own, i - a, j - a)
        label[a:b] = own + a
    return label, links


def index(members: DataFrame, level: int, radius: int, bucket: float) -> DataFrame:
    """One level: FOUND rows (fp, root, n) for links, (fp, path) for members of buckets passed on."""

    def spread(batches):
        for batch in batches:
            fp, path = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for p in np.unique(path).tolist():
                own, (names, fixed) = fp[path == p], variants(p, level, radius)
                for k in range(0, len(own), 1024):
                    some = own[k : k + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(some, len(names)), np.tile(fixed.view(np.int64), len(some)), np.tile(names, len(some)))], ["fp", "mask", "path"])

    def verify(batches):
        fp, path, part = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)  # of the last bucket, whose end hasn't come yet
        passing = None  # its key, if it has turned out too large and its members so far have gone out
        for batch in batches:
            f, m, p = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            f = f.view(np.uint64)
            fp, path, part = (np.concatenate(c) for c in ((fp, f), (path, p), (part, f & m.view(np.uint64))))
            if not len(fp):
                continue
            start = np.concatenate(([0], np.flatnonzero((part[1:] != part[:-1]) | (path[1:] != path[:-1])) + 1, [len(fp)]))
            big = np.diff(start) > bucket
            big[0] |= passing == (int(part[0]), int(path[0]))
            passing = (int(part[-1]), int(path[-1])) if big[-1] else None
            done = len(big) if big[-1] else len(big) - 1
            yield from emit(fp, path, start[: done + 1], big[:done])
            fp, path, part = (c[start[done] :] for c in (fp, path, part))
        if len(fp):
            yield from emit(fp, path, np.array([0, len(fp)]), np.array([False]))

    def emit(fp, path, start, big):
        size = np.diff(start)
        out = np.flatnonzero(np.repeat(big, size))
        if len(out):
            empty = pa.nulls(len(out), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(fp[out].view(np.int64)), empty, empty, pa.array(path[out])], ["fp", "root", "n", "path"])
        own = np.flatnonzero(np.repeat(~big, size))
        f = fp[own]
        label, n = linked(f, path[own], np.append(0, np.cumsum(size[~big])), level, radius)
        got = np.flatnonzero(n)
        if len(got):
            cols = [pa.array(c) for c in (f[got].view(np.int64), f[label[got]].view(np.int64), n[got])]
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(got), pa.int64())], ["fp", "root", "n", "path"])

    part = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = map_batches(members, spread, "fp long, mask long, path long").repartition(part, F.col("path"))
    return staged(map_batches(dealt.sortWithinPartitions(part, "path", "fp"), verify, FOUND), "links")


def links(distinct: DataFrame, radius: int, *, bucket: int = 1 << 14, levels: int = 3) -> DataFrame:
    """fp, root, n: for each bucket in which a distinct fingerprint has n links, a fingerprint that they lead to."""
    members, found = distinct.select("fp", F.lit(0).cast("long").alias("path")), []
    for level in range(levels):
        table = index(members, level, radius, bucket if level + 1 < levels else float("inf"))
        found.append(table.where("path is null").select("fp", "root", "n"))
        members = table.where("path is not null").select("fp", "path")
        if members.isEmpty():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def classes(fps: DataFrame, radius: int) -> DataFrame:
    """fp, root (one fp of its component), component_id, n_links of each fp in (doc_id, fp)."""
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(distinct, radius)
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("fp"), "root")
    ends = found.groupBy("fp").agg(F.sum("n").alias("n_links"))
    joined = distinct.join(roots, "fp").join(ends, "fp")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(joined.join(least, "root").select("fp", "root", "component_id", "n_links"), "components")
    return distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id, n_links for each row of docs.

    component_id is the smallest doc_id that is reachable over links of at most ``radius``
    bits. n_links counts the other distinct fingerprints within radius of the row's own.

    Nulls: a null text is empty; a text without words has fingerprint zero, linked like any
    other. A null id is reachable but never a component_id, unless all ids of a component are
    null. Ties: rows that repeat an id are separate rows of one name. An empty table gives an
    empty result. Other columns are ignored.
    """
    d = staged(fingerprints(docs, id_col, text_col, shingle=shingle), "fingerprints")
    return d.join(classes(d, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row of each component, that with the smallest id.

    A row is judged by its id and its own fingerprint. Nulls: a null text is empty; a null id
    is larger than any other. Ties: of a component's rows that share the smallest id one stays.
    An empty table stays empty.
    """
    name, at = fresh_name(docs, "fp"), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in text_bytes(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], [*batch.schema.names, name])

    seen = staged(map_batches(docs, run, StructType([*docs.schema, StructField(name, LongType())])), "documents-and-fingerprints")
    key, least = fresh_name(seen, "component"), fresh_name(seen, "least")
    own = classes(seen.select(F.col(id_col).alias("doc_id"), F.col(name).alias("fp")), radius).select(F.col("fp").alias(name), F.col("root").alias(key), F.col("component_id").alias(least))
    rows = seen.join(own, name).where(F.col(id_col).eqNullSafe(F.col(least)))
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(key)
    return one_of_each(rows, key, again).select(*docs.columns)
