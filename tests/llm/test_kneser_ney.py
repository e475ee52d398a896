"""The toxicity model's ratios against a model of exact counts by brute force."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from websieve.llm.toxicity import DISCOUNT, ORDER, gram_counts, learn


def windows(word):
    padded = b"\x01" * (ORDER - 1) + word + b"\x02"
    return [padded[k - ORDER + 1 : k + 1] for k in range(ORDER - 1, len(padded))]


def brute_ratio(rows):
    counts = [Counter(), Counter()]
    every = set()
    for text, label in rows:
        for g in (g for w in text.encode().split() for g in windows(w)):
            every.add(g)
            if label is not None:
                counts[label][g] += 1
    levels, above = [], every
    for _ in range(ORDER - 1):
        levels.append(Counter(g[1:] for g in above))
        above = set(levels[-1])

    def totals(n):
        total, kinds = Counter(), Counter()
        for g, c in n.items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        return n, total, kinds

    levels, tops = [totals(n) for n in levels[::-1]], [totals(c) for c in counts]

    def mixed(level, g, below):
        n, total, kinds = level
        t = total[g[:-1]]
        return max(n[g] - DISCOUNT, 0) / t + DISCOUNT * kinds[g[:-1]] / t * below if t else below

    def ratio(word):
        out = 0.0
        for g in windows(word):
            p = 1 / 256
            for m, level in enumerate(levels, 1):
                p = mixed(level, g[-m:], p)
            out += math.log(mixed(tops[1], g, p)) - math.log(mixed(tops[0], g, p))
        return out

    return ratio


def test_counts_are_exact_among_many_grams(spark):
    """Some 100,000 distinct 5-grams: in any table of 2^20 slots thousands would share one."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randrange(1, 12)))
    rows = [(" ".join(word() for _ in range(60)), rng.choice([0, 0, 1, None])) for _ in range(300)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id bigint, text string, label int")
    model, want = learn(gram_counts(df)), brute_ratio(rows)
    words = sorted({w for t, _ in rows for w in t.encode().split()}) + [b"unseen!", "é".encode(), b"q"]
    got, size = model.ratio(words)
    assert np.allclose(got, [want(w) for w in words], rtol=1e-9, atol=1e-9) and size.tolist() == [len(w) + 1 for w in words]
    empty = learn(gram_counts(df.limit(0)))
    assert empty.ratio([b"abc"])[0].tolist() == [0.0]
