"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

Each window of an item is a set of shingles, and a document holds the window only if it holds
all of them. So one necessary token per window is enough to find every candidate: the shingle
that the corpus has least often. Steps:

1. count, over all documents, how often each benchmark shingle occurs (partial counts are
   summed, the result is bounded by the benchmark);
2. order the shingles by rarity and index each window under its rarest one;
3. join: slide over a document, look its shingles up in the index of prefix tokens; a hit at
   position p for a window whose token stands at offset o gives the start p - o. Starts below
   zero or too close to the end (positional and length bound) go;
4. verify the whole window word by word and mark its words.

A document is one row, so the join runs where the document is and shuffles nothing, however
many documents share a passage. The benchmark side comes in blocks of about ``block_words``
words. One block at a time is read by the driver, broadcast and searched in a pass of its own;
a pass adds to the hits of those before, which are staged with their document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import keyed, map_batches, staged, text_bytes

#: Byte map: A-Z to lower case, each other ASCII byte that isn't a digit or letter to a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive ids; equal ids have equal hashes."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _MIX + ids[k : k + len(out)]
        return out ^ (out >> np.uint64(29))


class Block:
    """Windows of some benchmark items, indexed by one shingle each."""

    def __init__(self, items: list[tuple], window: int, shingle: int):
        self.window, self.shingle = window, shingle
        self.vocabulary: dict[bytes, int] = {}
        self.names = [str(i) for i, _ in items]
        windows: dict[tuple, list[int]] = {}
        for k, (_, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of((text or "").encode())]
            size = min(window, len(ids))
            for s in range(len(ids) - size + 1 if ids else 0):
                owners = windows.setdefault(tuple(ids[s : s + size]), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.windows = [(np.array(w, np.uint64), owners) for w, owners in windows.items()]
        self.tokens = {n: np.unique(np.concatenate(x)) for n, x in self._by_size().items()}

    def _size(self, w: np.ndarray) -> int:
        return min(self.shingle, len(w))

    def _by_size(self) -> dict[int, list[np.ndarray]]:
        found: dict[int, list[np.ndarray]] = {}
        for w, _ in self.windows:
            found.setdefault(self._size(w), []).append(rolling(w, self._size(w)))
        return found

    def ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter(map(get, words, repeat(0)), np.uint64, len(words))

    def counts(self, words: list[bytes], totals: dict[int, np.ndarray]) -> None:
        ids = self.ids(words)
        for n, tokens in self.tokens.items():
            r = known(ids, rolling(ids, n), n)
            at = np.minimum(np.searchsorted(tokens, r), len(tokens) - 1)
            totals[n] += np.bincount(at[tokens[at] == r], minlength=len(tokens))

    def index(self, frequency: dict[tuple[int, int], int]) -> None:
        """Put each window under its rarest shingle; of equally rare ones, the first."""
        buckets: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for k, (w, _) in enumerate(self.windows):
            n = self._size(w)
            r = rolling(w, n).tolist()
            o = min(range(len(r)), key=lambda i: (frequency.get((n, r[i]), 0), i))
            buckets.setdefault(n, {}).setdefault(r[o], []).append((k, o))
        self.buckets = buckets
        self.prefix = {n: np.array(sorted(b), np.uint64) for n, b in buckets.items()}

    def search(self, words: list[bytes], hit: np.ndarray) -> set[str]:
        """Mark hit words; return the names of items with a window in the document."""
        ids, found = self.ids(words), set()
        for n, prefix in self.prefix.items():
            r = known(ids, rolling(ids, n), n)
            at = np.minimum(np.searchsorted(prefix, r), len(prefix) - 1)
            where = np.flatnonzero(prefix[at] == r)
            if not len(where):
                continue
            order = np.argsort(at[where], kind="stable")
            where, which = where[order], at[where][order]
            for part in np.split(where, np.flatnonzero(np.diff(which)) + 1):
                for k, o in self.buckets[n][int(r[part[0]])]:
                    w, owners = self.windows[k]
                    start = part - o
                    start = start[(start >= 0) & (start + len(w) <= len(ids))]
                    for j, x in enumerate(w):
                        start = start[ids[start + j] == x]
                    if len(start):
                        found.update(self.names[i] for i in owners)
                        hit[(start[:, None] + np.arange(len(w))).ravel()] = True
        return found


def known(ids: np.ndarray, r: np.ndarray, n: int) -> np.ndarray:
    """r, with 0 where one of the n words isn't in the benchmark at all."""
    if len(r):
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        r = np.where(unknown[n:] == unknown[:-n], r, np.uint64(0))
    return r


def blocks_of(benchmark: DataFrame, window: int, shingle: int, block_words: int) -> tuple[int, Callable[[int], Block]]:
    """How many blocks the benchmark's items make, and what reads one of them to the driver."""
    b = benchmark.where("text2 is not null")
    total = b.agg(F.sum(F.size(F.split("text2", r"\s+")))).first()[0] or 0
    n = -(-total // block_words)
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text2"), F.lit(max(1, n)))
    return n, lambda k: Block([tuple(r) for r in b.where(part == k).collect()], window, shingle)


def sent(d: DataFrame, block: Block) -> Broadcast | None:
    """The block, indexed, on the executors; the driver keeps no copy."""
    if not block.windows:
        return None
    block.index(shingle_counts(d, block))
    return d.sparkSession.sparkContext.broadcast(block)


def shingle_counts(d: DataFrame, block: Block) -> dict[tuple[int, int], int]:
    shared = d.sparkSession.sparkContext.broadcast(block)

    def run(batches):
        b = shared.value
        totals = {n: np.zeros(len(t), np.int64) for n, t in b.tokens.items()}
        for batch in batches:
            for text in text_bytes(batch.column(1)):
                b.counts(words_of(text), totals)
        for n, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(b.tokens[n][at].view(np.int64)), pa.array(c[at])], ["n", "token", "c"])

    rows = map_batches(d, run, "n int, token long, c long").groupBy("n", "token").agg(F.sum("c").alias("c")).collect()
    return {(r.n, r.token % 2**64): r.c for r in rows}


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    *, window: int = 10, shingle: int = 5, block_words: int = 2_000_000,
) -> DataFrame:
    """doc_id, n_words, n_hit, hits, items, items_sha256, contaminated for each row of docs.

    Words are runs of ASCII letters and digits (A-Z lower-cased) and non-ASCII characters. A
    window is ``window`` consecutive words of an item; an item of fewer words, but not none, is
    one window. ``hits`` lists the hit word ranges [from, to), ``items`` the item ids as
    strings, sorted as strings.

    Nulls: a null or empty text has no words; an item with a null text has no window; an item
    with a null id is called None. Ties: items that repeat an id count once. An empty benchmark
    or table gives no hits or no rows. Other columns are ignored.
    """
    d = keyed(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).alias("doc_id"), F.col(item_text_col).alias("text2"))
    n, block = blocks_of(items, window, shingle, block_words)
    kind = d.schema["doc_id"].dataType.simpleString()
    found_so_far = d
    for k in range(n - 1):
        shared = sent(d, block(k))
        if shared:
            found_so_far = staged(map_batches(found_so_far, searcher(shared, False), f"doc_id {kind}, text string, hits array<int>, items array<string>"), "hits")
            shared.destroy()
    last = sent(d, block(n - 1)) if n else None
    return map_batches(found_so_far, searcher(last, True), f"doc_id {kind}, n_words long, n_hit long, hits array<int>, items array<string>, items_sha256 string, contaminated boolean")


def searcher(shared: Broadcast | None, last: bool):
    """Adds a block's hits to those of earlier passes (columns hits, items, if any); the last pass gives the result."""

    def run(batches):
        for batch in batches:
            out, none = [], [[]] * batch.num_rows
            hits, items = (batch.column(2).to_pylist(), batch.column(3).to_pylist()) if batch.num_columns > 2 else (none, none)
            for text, old, names in zip(text_bytes(batch.column(1)), hits, items):
                words = words_of(text)
                hit, found = np.zeros(len(words) + 2, bool), set(names)
                for a, b in zip(old[::2], old[1::2]):
                    hit[a + 1 : b + 1] = True
                if shared:
                    found |= shared.value.search(words, hit[1:-1])
                names = sorted(found)
                edges = np.flatnonzero(np.diff(hit.view(np.int8))).tolist()
                out.append((len(words), int(hit.sum()), edges, names, hashlib.sha256(",".join(names).encode()).hexdigest()))
            cols = list(zip(*out)) or [()] * 5
            spans, names = pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.string()))
            if last:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), spans, names, pa.array(cols[4], pa.string()), pa.array([n > 0 for n in cols[1]], pa.bool_())],
                    ["doc_id", "n_words", "n_hit", "hits", "items", "items_sha256", "contaminated"],
                )
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), spans, names], ["doc_id", "text", "hits", "items"])

    return run


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    *, window: int = 10, shingle: int = 5, block_words: int = 2_000_000,
) -> DataFrame:
    """docs without the contaminated rows, as ``decontaminate`` describes them.

    Each row is judged where it is, by its own text: nothing is joined, and repeated or null
    ids change nothing. A null text has no words and stays; without benchmark items all rows
    stay; an empty table stays empty.
    """
    items = benchmark.select(F.col(item_col).alias("doc_id"), F.col(item_text_col).alias("text2"))
    n, block = blocks_of(items, window, shingle, block_words)
    at = docs.columns.index(text_col)
    for k in range(n):
        shared = sent(keyed(docs, id_col, text_col), block(k))
        if shared:
            docs = map_batches(docs, cleaner(shared, at), docs.schema)
            if k < n - 1:
                docs = staged(docs, "clean")
                shared.destroy()
    return docs


def cleaner(shared: Broadcast, at: int):
    """Passes on the rows whose text, column ``at``, holds no window of the block."""

    def run(batches):
        for batch in batches:
            words = map(words_of, text_bytes(batch.column(at)))
            clean = [not shared.value.search(w, np.zeros(len(w), bool)) for w in words]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run
