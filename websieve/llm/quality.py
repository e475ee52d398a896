"""Quality by co-training of a text-content and a page-metadata classifier.

One pass turns each document into two views: numbers about its text, and numbers about its
metadata (language, source, length, as hashed indicators). They go to a stage table with the
labels, so texts are read once. Both classifiers start from labelled rows. In each round each
one scores all unlabelled rows, and the rows that it is most confident about join the *other*
one's training rows with that pseudo-label; then both are fitted again. Unlabelled rows stay
where they are: a round is a histogram of their log-odds, which sets the confidence to ask
for, and a few Newton steps over sums of gradients and curvatures, all added up by Spark. Which
rows have joined follows from the models and bounds of earlier rounds, so no row has a state.

At the end each view is calibrated on labelled rows that no classifier was fitted on, and a
logistic curve over both calibrated log-odds combines them and scores all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from .logistic import fit_logistic, sigmoid
from .tables import fresh_name, left_join, map_batches, staged, text_bytes, thinned

LANGS, SOURCES = 16, 64
TEXT_VIEW = 20
META_VIEW = LANGS + SOURCES + 2
WIDTHS = (2 * TEXT_VIEW, META_VIEW)
#: Bins of a histogram of log-odds from 0 to ODDS, on either side.
BINS, ODDS = 4096, 40.0
_LETTERS = bytes(1 if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
_KIND = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b < 128 else 5 for b in range(256)], np.uint8)


def text_view(text: bytes) -> list[float] | float:
    """Shares and means about words, characters and lines of a whole text; 0 for none."""
    words = text.split()
    if not words:
        return 0.0
    n, size, lines = len(words), len(text), text.split(b"\n")
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=6) / size
    lens = np.fromiter(map(len, words), np.int64, n)
    distinct = set(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    symbols = sum(not w.isalnum() and w.isascii() and not any(map(_LETTERS.__getitem__, w)) for w in distinct)
    marks = [text.count(c) / n for c in (b"|", b".", b",", b"@", b"#", b"%", b"&")]
    return [
        *kinds[:5].tolist(), len(set(lines)) / len(lines), float(lens.mean()), float(lens.std()), float((lens <= 3).mean()), float((lens >= 16).mean()),
        len(distinct) / n, again, symbols / len(distinct), *marks,
    ]


def meta_views(langs: pa.Array, sources: pa.Array, sizes: pa.Array) -> np.ndarray:
    """A row of indicators and of the logarithm of the size and its square for each document."""
    out, rows, log = np.zeros((len(langs), META_VIEW), np.float32), np.arange(len(langs)), np.log1p(sizes.to_numpy(zero_copy_only=False).astype(float))
    for values, first, slots in ((langs, 0, LANGS), (sources, LANGS, SOURCES)):
        kinds = values.fill_null("").dictionary_encode()
        of = np.array([xxhash.xxh32_intdigest(v.encode()) % slots for v in kinds.dictionary.to_pylist()], np.int64)
        out[rows, first + of[kinds.indices.to_numpy()]] = 1.0
    out[:, -2], out[:, -1] = log, log * log
    return out


def lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def views(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> tuple[DataFrame, list[str]]:
    """docs with the columns text_view and meta_view (arrays of float), and how these are called."""
    at = [docs.columns.index(c) for c in (text_col, lang_col, source_col)]
    names = [fresh_name(docs, "text_view"), fresh_name(docs, "meta_view")]

    def run(batches):
        for batch in batches:
            texts, langs, sources = (batch.column(k) for k in at)
            t = np.zeros((len(texts), TEXT_VIEW), np.float32)
            for k, text in enumerate(text_bytes(texts)):
                t[k] = text_view(text)
            m = meta_views(langs, sources, pc.fill_null(pc.utf8_length(texts), 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists(t), lists(m)], [*batch.schema.names, *names])

    return map_batches(docs, run, StructType([*docs.schema, *(StructField(n, ArrayType(FloatType())) for n in names)])), names


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def curved(x: np.ndarray) -> np.ndarray:
    """A view with its squares, so that both very low and very high shares can speak."""
    return np.column_stack([x, x * x])


def both_views(batch, first: int) -> list[np.ndarray]:
    return [curved(matrix(batch.column(first), TEXT_VIEW)), matrix(batch.column(first + 1), META_VIEW)]


def bin_of(z: np.ndarray) -> np.ndarray:
    return np.minimum((np.abs(z) * (BINS / ODDS)).astype(np.int64), BINS - 1)


class CoTraining:
    """Two logistic views, pseudo-labels exchanged over rounds, calibrated and combined.

    ``total(fn)`` adds up fn(views) over all unlabelled rows; fn takes both views of some rows
    and gives one vector. ``history`` holds each round's models, and for each of these the bins
    of log-odds, of class 0 and 1, from which on its rows join the other view.
    """

    def __init__(self, rounds: int = 5, confident: float = 0.97, share: float = 0.05, steps: int = 6, ridge: float = 1e-2):
        self.rounds, self.share, self.steps, self.ridge = rounds, share, steps, ridge
        self.least = int(bin_of(np.log(confident / (1 - confident))))

    def fit(self, labelled: list[np.ndarray], y: np.ndarray, n_pool: int, total, calibrate: list[np.ndarray], cy: np.ndarray) -> CoTraining:
        self.models, self.history, self.exchanged = [fit_logistic(x, y, self.ridge) for x in labelled], [], [0, 0]
        self.scaling = [(x.mean(axis=0), np.where(x.std(axis=0) > 1e-12, x.std(axis=0), 1.0)) for x in labelled]
        for _ in range(self.rounds if n_pool else 0):
            tails = total(self.histogram).reshape(2, 2, BINS)[..., ::-1].cumsum(axis=-1)[..., ::-1]
            most = max(1, int(self.share * n_pool))
            bounds = [[self.bound(tail, most) for tail in own] for own in tails]
            new = [sum(int(tail[b]) for tail, b in zip(own, bs) if b < BINS) for own, bs in zip(tails, bounds)]
            self.history = [*self.history, (self.models, bounds)]
            self.exchanged = [self.exchanged[t] + new[1 - t] for t in (0, 1)]
            if not any(new):
                break
            self.refit(labelled, y, total)
        odds = [x @ w + b for x, (w, b) in zip(calibrate, self.models)]
        self.platt = [fit_logistic(o[:, None], cy) for o in odds]
        logits = np.column_stack([w[0] * o + b for o, (w, b) in zip(odds, self.platt)])
        self.joint = fit_logistic(logits, cy, ridge=0.1)
        return self

    def bound(self, tail: np.ndarray, most: int) -> int:
        """The first bin with at most ``most`` rows from it on, or the last one that has any."""
        b = max(self.least, int(np.argmax(tail <= most)) if tail[-1] <= most else BINS)
        return b if b < BINS and tail[b] else int(np.flatnonzero(tail[self.least :])[-1]) + self.least if tail[self.least] else BINS

    def pseudo_labels(self, t: int, views: list[np.ndarray]) -> np.ndarray:
        """The label with which each row has joined view t, NaN for none."""
        y, k = np.full(len(views[0]), np.nan), 1 - t
        for models, bounds in self.history:
            z = views[k] @ models[k][0] + models[k][1]
            at = bin_of(z)
            for side in (0, 1):
                y[np.isnan(y) & ((z > 0) == side) & (at >= bounds[k][side])] = side
        return y

    def histogram(self, views: list[np.ndarray]) -> np.ndarray:
        """[view, class, bin]: rows that haven't joined the other view yet, by this view's log-odds."""
        out = np.zeros((2, 2, BINS))
        for k in (0, 1):
            free = np.isnan(self.pseudo_labels(1 - k, views))
            z = (views[k] @ self.models[k][0] + self.models[k][1])[free]
            for side in (0, 1):
                out[k, side] = np.bincount(bin_of(z[(z > 0) == side]), minlength=BINS)
        return out.ravel()

    def slopes(self, t: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Curvature, gradient, number of rows and value of view t's loss at its weights, as one vector."""
        mean, scale = self.scaling[t]
        a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        z = a @ self.weights[t]
        p = sigmoid(z)
        return np.concatenate([((a * (p * (1 - p))[:, None]).T @ a).ravel(), a.T @ (p - y), [len(x), (np.logaddexp(0, z) - y * z).sum()]])

    def gradients(self, views: list[np.ndarray]) -> np.ndarray:
        """Both views' slopes over the rows that have joined."""
        out = []
        for t in (0, 1):
            y = self.pseudo_labels(t, views)
            out.append(self.slopes(t, views[t][~np.isnan(y)], y[~np.isnan(y)]))
        return np.concatenate(out)

    def refit(self, labelled: list[np.ndarray], y: np.ndarray, total) -> None:
        """Newton steps from the present models, over labelled rows and those that have joined.

        A step that doesn't lower the loss is halved until it does.
        """
        self.weights = [np.append(w * scale, b + w @ mean) for (w, b), (mean, scale) in zip(self.models, self.scaling)]
        best: list = [None, None]
        for _ in range(self.steps):
            added, moving = total(self.gradients), 0.0
            for t in (0, 1):
                v, d = self.weights[t], len(self.weights[t])
                own, added = added[: d * d + d + 2] + self.slopes(t, labelled[t], y), added[d * d + d + 2 :]
                penalty = np.append(np.full(d - 1, self.ridge * own[-2] ** 0.5), 1e-6)
                loss = own[-1] + 0.5 * penalty @ (v * v)
                if best[t] is None or loss < best[t][0]:
                    step = np.linalg.solve(own[: d * d].reshape(d, d) + np.diag(penalty + 1e-9), own[d * d : -2] + penalty * v)
                    best[t] = loss, v, step * min(1.0, 5.0 / max(float(np.abs(step).max()), 1e-12))
                else:
                    best[t] = *best[t][:2], best[t][2] / 2
                self.weights[t] = best[t][1] - best[t][2]
                moving = max(moving, float(np.abs(best[t][2]).max()))
            if moving < 1e-3:
                break
        self.models = [(v[:-1] / scale, float(v[-1] - (v[:-1] / scale) @ mean)) for (_, v, _), (mean, scale) in zip(best, self.scaling)]

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of each view, and both views combined."""
        logits = [w[0] * (x @ m + c) + b for x, (m, c), (w, b) in zip((text, meta), self.models, self.platt)]
        w, b = self.joint
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(np.column_stack(logits) @ w + b)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def total_over(rows: DataFrame, fn) -> np.ndarray:
    """The sum of fn over all rows (doc_id, text_view, meta_view); Spark adds up the tasks' sums."""
    size = len(fn([np.zeros((0, w)) for w in WIDTHS]))

    def run(batches):
        out = np.zeros(size)
        for batch in batches:
            out += fn(both_views(batch, 1))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], ["i", "v"])

    found = map_batches(rows, run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


def _sample(rows: DataFrame, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    t = thinned(rows, n).toArrow()
    x = [matrix(t.column(c).combine_chunks(), w) for c, w in (("text_view", TEXT_VIEW), ("meta_view", META_VIEW))]
    return [curved(x[0]), x[1]], t.column("label").to_numpy().astype(float)


def learn(found: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int, rounds: int) -> tuple[DataFrame, CoTraining | None, float]:
    """(found as a stage table with label and fold, the model or None, share of good labelled rows)."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("fold", fold_of(F.col("doc_id"))).where("fold > 0")
    rows = staged(left_join(found, known, "doc_id"), "views")
    of = lambda which: rows.where(which).select("doc_id", "text_view", "meta_view", "label")
    train, y = _sample(of("fold > 1"), sample)
    calibrate, cy = _sample(of("fold = 1"), sample)
    model, share = None, float(y.mean()) if len(y) else 0.5
    if 0 < y.sum() < len(y) and 0 < cy.sum() < len(cy):
        pool = of("label is null")
        model = CoTraining(rounds).fit(train, y, pool.count(), lambda fn: total_over(pool, fn), calibrate, cy)
    return rows, model, share


def quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality",
    *, sample: int = 20_000, rounds: int = 5,
) -> DataFrame:
    """doc_id, held_out, text_score, meta_score, score, predicted for each row of docs.

    Rows fall into five folds by crc32 of the id as text: fold 0 is held out and its labels
    are never read, fold 1 calibrates, folds 2 to 4 train. ``sample`` bounds the labelled rows
    of either use, about as many of which a hash of the id picks; all unlabelled rows take part.

    Nulls: null text, language or source count as empty; a null label is none; a row with a
    null id is unlabelled; of an id's several labels the largest counts. Ties: rows that repeat
    an id share its label, and each is scored by its own content. A text without words has an
    all-zero text view, is scored like any other and predicted 0. If no class boundary can be
    fitted (no labels, or one class only), scores are the share of good rows (0.5 without
    labels) and every row is predicted 1: nothing learnt, nothing rejected. An empty table gives an empty
    result. Texts of any length are read whole. Other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    found, _ = views(d, "text", "lang", "source")
    rows, model, share = learn(found.select("doc_id", "text_view", "meta_view"), labels, id_col, label_col, sample, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s, good = verdicts(shared.value, share, both_views(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in s), pa.array(good)], ["doc_id", "text_score", "meta_score", "score", "good"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = map_batches(rows.select("doc_id", "text_view", "meta_view"), run, f"doc_id {kind}, text_score double, meta_score double, score double, good boolean")
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "text_score", "meta_score", "score", F.col("good").cast("int").alias("predicted"))


def verdicts(model: CoTraining | None, share: float, x: list[np.ndarray]) -> tuple[tuple, np.ndarray]:
    """(scores by text, by metadata and by both; whether the row is good) of some rows."""
    n = len(x[0])
    if model is None:
        return (np.full(n, share),) * 3, np.ones(n, bool)
    s = model.score(*x)
    return s, (s[2] >= 0.5) & x[0].any(axis=1)


def drop_poor(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality",
    *, sample: int = 20_000, rounds: int = 5,
) -> DataFrame:
    """docs without the rows that the classifier rejects, as ``quality`` describes it.

    Each row is judged by its own content and carries its verdict, so repeated and null ids
    change nothing. Without usable labels no row goes. An empty table stays empty.
    """
    seen, names = views(docs, text_col, lang_col, source_col)
    seen = staged(seen, "documents-and-views")
    found = seen.select(F.col(id_col).alias("doc_id"), *(F.col(n).alias(c) for n, c in zip(names, ("text_view", "meta_view"))))
    _, model, share = learn(found, labels, id_col, label_col, sample, rounds)
    shared, width = docs.sparkSession.sparkContext.broadcast(model), len(docs.columns)

    def run(batches):
        for batch in batches:
            good = verdicts(shared.value, share, both_views(batch, width))[1]
            yield pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width]).filter(pa.array(good))

    return map_batches(seen, run, docs.schema)
