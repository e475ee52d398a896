"""URL rules through a Bloom filter cascade: exact membership without joins.

Level 1 encodes the listed keys. The corpus's complete key universe is tested against it; the
keys that pass but aren't listed are its false positives, which level 2 encodes; the listed
keys that level 2 wrongly holds go to level 3, and so on until no error is left. A key of the
universe is listed if the first level that rejects it is an even one. Each level's bit count
is fixed by the count of its keys, which is checked before anything is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_batches, staged

HASHES = 5


class Bloom:
    def __init__(self, keys: int, salt: int, bits_per_key: float):
        self.salt, self.m = salt, 64 * -(-max(64, int(keys * bits_per_key)) // 64)
        self.bits = np.zeros(self.m // 8, np.uint8)

    def places(self, key: str) -> list[int]:
        h = xxhash.xxh3_128_intdigest(key.encode(), self.salt)
        a, b = h >> 64, h | 1
        return [(a + k * b) % 2**64 % self.m for k in range(HASHES)]

    def add(self, keys: Iterable[str]) -> Bloom:
        for key in keys:
            for p in self.places(key):
                self.bits[p >> 3] |= 1 << (p & 7)
        return self

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.places(key))


class Cascade:
    """Alternate levels; levels[0] encodes the listed keys."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def candidate_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of all rules that could fit, the longest first."""
    labels = host.split(".")
    hosts = [".".join(labels[k:]) for k in range(len(labels))] if host else []
    return sorted({h + path[:n] for h in hosts for n in lengths if len(path) >= n}, key=lambda k: (-len(k), k))


def universe(pages: DataFrame, url_col: str, lengths: list[int], keep) -> DataFrame:
    """The distinct candidate keys of all pages that keep(key) is true for."""

    def run(batches):
        for batch in batches:
            seen = {k for url in dict.fromkeys(batch.column(0).to_pylist()) for k in candidate_keys(*split_url(url), lengths)}
            yield pa.RecordBatch.from_arrays([pa.array([k for k in seen if keep(k)], pa.string())], ["key"])

    return map_batches(pages.select(F.col(url_col).alias("url")), run, "key string").distinct()


def encode(keys: DataFrame, n: int, salt: int, bits_per_key: float) -> Bloom:
    """A filter of n keys, its words OR-ed before they come to the driver (at most m bits)."""
    level = Bloom(n, salt, bits_per_key)

    def run(batches):
        own = Bloom(n, salt, bits_per_key)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        words = own.bits.view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["word", "bits"])

    words = level.bits.view("<i8")
    for r in map_batches(keys, run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        words[r.word] = r.bits
    return level


def build_cascade(pages: DataFrame, url_col: str, listed: list[str], lengths: list[int], *, bits_per_key: float, max_bits: int) -> Cascade:
    known, levels = frozenset(listed), [Bloom(len(listed), 0, bits_per_key).add(listed)]
    first, left = levels[0], list(listed)
    wrong = staged(universe(pages, url_col, lengths, lambda k: k in first and k not in known), "false-positives") if listed else None
    while wrong is not None and (n := wrong.count()):
        if n * bits_per_key > max_bits:
            raise ValueError("the cascade's next level exceeds max_bits; raise bits_per_key, so that fewer keys get there")
        levels.append(level := encode(wrong, n, len(levels), bits_per_key))
        if not (left := [k for k in left if k in level]):
            break
        levels.append(again := Bloom(len(left), len(levels), bits_per_key).add(left))
        wrong = staged(_passing(wrong, again), "false-positives")
    return Cascade(levels)


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for k in batch.column(0).to_pylist() if k in level], pa.string())], ["key"])

    return map_batches(keys, run, "key string")


def filter_urls(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", *, default: str = "allow", bits_per_key: float = 12.0, max_bits: int = 1 << 28
) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    rules are (verdict, host, path). A rule fits its host and all subdomains, if the url's path
    starts with the rule's path; of several, the longest host plus path wins. Where none fits,
    which the cascades decide exactly, ``rule`` is null and the verdict is ``default``.

    Nulls: a null url, or one without ``://``, has an empty host and path and fits no rule. A
    host is taken as it stands, with any port. Ties: equal rules of both verdicts are an error.
    An empty table gives an empty result; without rules all is default. Rules beyond max_bits
    of filter are an error before anything is sent. Other columns are ignored.
    """
    rules = [(v, h.encode().lower().decode(), p) for v, h, p in rules]
    if len(rules) * bits_per_key > max_bits:
        raise ValueError("more rules than max_bits allows")
    if len({h + p for _, h, p in rules}) < len({(v, h + p) for v, h, p in rules}):
        raise ValueError("a rule has two verdicts")
    lengths = sorted({len(p) for _, _, p in rules})
    lists = {v: sorted({h + p for w, h, p in rules if w == v}) for v in sorted({r[0] for r in rules})}
    cascades = {v: build_cascade(pages, url_col, keys, lengths, bits_per_key=bits_per_key, max_bits=max_bits) for v, keys in lists.items()}
    shared = pages.sparkSession.sparkContext.broadcast(cascades)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = next(((k, v) for k in candidate_keys(host, path, lengths) for v, c in shared.value.items() if k in c), (None, default))
                out.append((host, path, rule, verdict))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), run, f"page_id {kind}, host string, path string, rule string, verdict string")
