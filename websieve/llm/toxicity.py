"""Toxicity from class-conditional Kneser-Ney models of the bytes in words.

Two interpolated Kneser-Ney models of order N predict each byte of a word from the bytes
before it in that word. Their highest order has counts of its own class (toxic or ordinary);
all lower orders are shared and count, over every document of the corpus, labelled or not,
how many different contexts a sequence continues. So a rare expression that one class hasn't
seen falls back on the same probabilities in both and speaks for neither.

A document's evidence is the log-likelihood ratio per byte, over the whole text and over its
most toxic stretch of ``stretch`` words. A logistic curve through these two, fitted on a fifth
of the labelled rows that no count comes from, gives the score.

Counting: each task counts its distinct words, cuts those into N-grams and sends distinct
N-grams with partial sums, which grow with the input; Spark adds them up exactly. The model
holds these counts as they are, in arrays sorted by the exact N-gram: an entry for each 5-gram
of the learning rows and each shorter sequence of the corpus. What is broadcast grows with the
distinct sequences, 16 to 40 bytes for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of
from .logistic import fit_logistic
from .tables import keyed, left_join, map_batches, staged, text_bytes, thinned

ORDER, DISCOUNT = 5, 0.75
FLUSH = 400_000


def positions(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with padding, places to predict, index of each place's word)."""
    pad = b"\x01" * (ORDER - 1)
    buf = np.frombuffer(b"".join([p for w in words for p in (pad, w, b"\x02")]), np.uint8).astype(np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lens + ORDER - 1)
    first = np.repeat(ends - np.cumsum(lens), lens)
    return buf, first + np.arange(len(first)), np.repeat(np.arange(len(words)), lens)


def grams(buf: np.ndarray, at: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """The n bytes that end at each place, or back bytes before it, as one exact number."""
    key = np.zeros(len(at), np.uint64)
    for j in range(n - 1, -1, -1):
        key = key << np.uint64(8) | buf[at - j - back]
    return key


def index_words(texts, vocabulary: dict[bytes, int]) -> list[np.ndarray]:
    """Word numbers of each text; new words join the vocabulary."""
    out = []
    for text in texts:
        words = words_of(text)
        out.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int64, len(words)))
    return out


def gram_counts(docs: DataFrame) -> DataFrame:
    """gram, toxic, ordinary: exact counts in the learning rows, for every N-gram of all rows.

    docs: doc_id, text, label (1, 0, or null for rows that only feed the shared orders).
    """

    def run(batches):
        vocabulary, counts = {}, [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def flush():
            words = list(vocabulary)
            buf, at, owner = positions(words)
            keys, inverse = np.unique(grams(buf, at, ORDER), return_inverse=True)
            sums = [np.bincount(inverse, weights=c[owner], minlength=len(keys)).astype(np.int64) for c in counts]
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])], ["gram", "toxic", "ordinary"])

        for batch in batches:
            ids = index_words(text_bytes(batch.column(1)), vocabulary)
            labels = batch.column(2).to_pylist()
            for c in (0, 1):
                own = [w for w, y in zip(ids, labels) if y == c]
                new = np.bincount(np.concatenate(own), minlength=len(vocabulary)) if own else np.zeros(len(vocabulary), np.int64)
                new[: len(counts[c])] += counts[c]
                counts[c] = new
            if len(vocabulary) >= FLUSH:
                yield flush()
                vocabulary, counts = {}, [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        if vocabulary:
            yield flush()

    parts = map_batches(docs.select("doc_id", "text", "label"), run, "gram long, toxic long, ordinary long")
    return parts.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class Counts:
    """Exact counts by N-gram; 0 for one that isn't there."""

    def __init__(self, keys: np.ndarray, columns: dict[str, np.ndarray]):
        self.keys, self.columns = keys, columns

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        if not len(self.keys):
            return {n: np.zeros(len(keys)) for n in self.columns}
        asked, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        there = self.keys[at] == asked
        return {n: np.where(there, c[at], 0.0)[back] for n, c in self.columns.items()}


def _collected(table: DataFrame, key: str, columns: dict) -> Counts:
    """The table's rows on the driver, sorted by key."""
    rows = table.select(key, *(c.cast("double").alias(n) for n, c in columns.items())).toArrow()
    keys = rows.column(key).to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    return Counts(keys[order], {n: rows.column(n).to_numpy()[order] for n in columns})


class KneserNey:
    """Both classes' models."""

    def __init__(self, top: Counts, context: Counts, lower: list[tuple[Counts, Counts]]):
        self.top, self.context, self.lower = top, context, lower

    def ratio(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratio (toxic to ordinary) and bytes, of each word."""
        if not words:
            return np.zeros(0), np.zeros(0)
        buf, at, owner = positions(words)
        p = np.full(len(at), 1 / 256)
        for m in range(1, ORDER):
            counts, totals = self.lower[m - 1]
            c, t = counts.find(grams(buf, at, m)), totals.find(grams(buf, at, m - 1, 1))
            p = mix(c["n"], t["n"], t["kinds"], p)
        c, t = self.top.find(grams(buf, at, ORDER)), self.context.find(grams(buf, at, ORDER - 1, 1))
        logs = [np.log(mix(c[k], t[k], t[f"{k}_kinds"], p)) for k in ("toxic", "ordinary")]
        return np.bincount(owner, weights=logs[0] - logs[1], minlength=len(words)), np.bincount(owner, minlength=len(words)).astype(float)


def mix(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Discounted share plus the discounted mass times the lower order; that alone if unseen."""
    t = np.maximum(total, 1)
    return np.where(total > 0, np.maximum(count - DISCOUNT, 0) / t + DISCOUNT * kinds / t * below, below)


def learn(counted: DataFrame) -> KneserNey:
    """A model of exact N-gram counts; every lower order is counted from the one above."""
    seen = counted.where("toxic > 0 or ordinary > 0")
    top = _collected(seen, "gram", {"toxic": F.col("toxic"), "ordinary": F.col("ordinary")})
    by = seen.groupBy(F.expr("shiftright(gram, 8)").alias("h")).agg(
        *(f(F.col(k)).alias(k + s) for k in ("toxic", "ordinary") for f, s in ((F.sum, ""), (lambda c: F.sum((c > 0).cast("long")), "_kinds")))
    )
    context = _collected(by, "h", {c: F.col(c) for c in by.columns[1:]})
    lower, above = [], counted.select("gram")
    for m in range(ORDER - 1, 0, -1):
        g = staged(above.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * m) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "continuations")
        h = g.groupBy(F.expr("shiftright(gram, 8)").alias("h")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        lower.append((_collected(g, "gram", {"n": F.col("n")}), _collected(h, "h", {"n": F.col("n"), "kinds": F.col("kinds")})))
        above = g
    return KneserNey(top, context, lower[::-1])


def evidence(docs: DataFrame, model: KneserNey, stretch: int) -> DataFrame:
    """doc_id, whole, worst: ratio per byte of the whole text and of its worst stretch."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            vocabulary: dict[bytes, int] = {}
            ids = index_words(text_bytes(batch.column(1)), vocabulary)
            ratio, size = shared.value.ratio(list(vocabulary))
            whole, worst = np.zeros(len(ids)), np.zeros(len(ids))
            for k, w in enumerate(ids):
                if len(w):
                    r, b = np.concatenate(([0], np.cumsum(ratio[w]))), np.concatenate(([0], np.cumsum(size[w])))
                    n = min(stretch, len(w))
                    whole[k], worst[k] = r[-1] / b[-1], ((r[n:] - r[:-n]) / (b[n:] - b[:-n])).max()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(whole), pa.array(worst)], ["doc_id", "whole", "worst"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, whole double, worst double")


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, stretch: int = 5, fit_rows: int = 50_000) -> DataFrame:
    """doc_id, held_out, score, predicted, whole, worst for each row of docs.

    Rows fall into five folds by crc32 of the id as text. Fold 0 is held out: its labels are
    never read. Fold 1 fits the curve, on about ``fit_rows`` rows at most (a hash of the
    id picks them); folds 2 to 4 are counted. Labels, language, source and id are no inputs.

    Nulls: a null or empty text has no evidence and gets the curve's value there; a null label
    is none; of an id's several labels the largest counts; a null id has no label. If the
    labels lack a class in a fold, a fixed curve is used. An empty table gives an empty result.
    Other columns are ignored.
    """
    d = keyed(docs, id_col, text_col)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("fold", fold_of(F.col("doc_id"))).where("fold > 0")
    learning = known.where("fold > 1").select("doc_id", "label")
    counted = staged(gram_counts(left_join(d, learning, "doc_id")), "grams")
    found = staged(evidence(d, learn(counted), stretch), "evidence")
    sample = thinned(found.join(known.where("fold = 1"), "doc_id").select("doc_id", "whole", "worst", "label"), fit_rows).toPandas()
    x, y = sample[["whole", "worst"]].to_numpy(float), sample["label"].to_numpy(float)
    weights, bias = fit_logistic(x, y) if 0 < y.sum() < len(y) else (np.array([1.0, 2.0]), -3.0)
    z = F.lit(float(bias)) + F.col("whole") * float(weights[0]) + F.col("worst") * float(weights[1])
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "whole", "worst")
