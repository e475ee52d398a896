"""Co-training rounds against a plain version, and the table's sums against numpy's."""

from __future__ import annotations

import numpy as np

from test_filters_and_models import corpus
from websieve.llm.quality import BINS, ODDS, WIDTHS, CoTraining, both_views, learn, quality, total_over, views


def samples(seed, n):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n).astype(float)
    x = [rng.normal(0, 1, (n, w)) for w in WIDTHS]
    for v in x:
        v[:, :3] += 0.8 * (y - 0.5)[:, None]
    return x, y


def plain_round(model, views, joined, share, confident):
    """Rows that each view gives to the other one, by sorting: {other view: {row: label}}."""
    out = {0: {}, 1: {}}
    for k in (0, 1):
        w, b = model[k]
        z = views[k] @ w + b
        at = [min(int(abs(v) * BINS / ODDS), BINS - 1) for v in z]
        least = int(np.log(confident / (1 - confident)) * BINS / ODDS)
        for side in (0, 1):
            free = sorted((r for r in range(len(z)) if r not in joined[1 - k] and (z[r] > 0) == side and at[r] >= least), key=lambda r: -at[r])
            most = max(1, int(share * len(z)))
            levels = sorted({at[r] for r in free}, reverse=True)
            took = []
            for level in levels:
                here = [r for r in free if at[r] == level]
                if took and len(took) + len(here) > most:
                    break
                took += here
                if len(took) >= most:
                    break
            out[1 - k].update((r, float(side)) for r in took)
    return out


def test_rounds():
    (x, y), (pool, _), (cal, cy) = samples(1, 200), samples(2, 3000), samples(3, 150)
    parts = [[v[k::7] for v in pool] for k in range(7)]
    model = CoTraining(rounds=3, confident=0.9, steps=60).fit(x, y, 3000, lambda fn: sum(map(fn, parts)), cal, cy)
    joined = {0: {}, 1: {}}
    for models, _ in model.history:
        new = plain_round(models, pool, joined, model.share, 0.9)
        for t in (0, 1):
            joined[t].update(new[t])
    assert len(model.history) == 3 and [len(joined[t]) for t in (0, 1)] == model.exchanged and min(model.exchanged) > 100
    for t in (0, 1):
        got = model.pseudo_labels(t, pool)
        assert {r: got[r] for r in np.flatnonzero(~np.isnan(got))} == joined[t]
        # At the fitted weights the penalised loss over labelled rows and those that joined has no slope.
        rows = sorted(joined[t])
        mean, scale = model.scaling[t]
        a = np.column_stack([(np.concatenate([x[t], pool[t][rows]]) - mean) / scale, np.ones(len(y) + len(rows))])
        labels = np.concatenate([y, [joined[t][r] for r in rows]])
        w, b = model.models[t]
        v = np.append(w * scale, b + w @ mean)
        penalty = np.append(np.full(len(w), model.ridge * len(a) ** 0.5), 1e-6)
        assert np.abs(a.T @ (1 / (1 + np.exp(-(a @ v))) - labels) + penalty * v).max() < 0.05


def test_table_sums_are_those_of_numpy(spark):
    d, labels = corpus(spark, 300)
    found, _ = views(d.select("doc_id", "text", "lang", "source"), "text", "lang", "source")
    rows, model, _ = learn(found.select("doc_id", "text_view", "meta_view"), labels, "doc_id", "quality", 20_000, 2)
    pool = rows.where("label is null").select("doc_id", "text_view", "meta_view")
    (batch,) = pool.toArrow().combine_chunks().to_batches()
    own = both_views(batch, 1)
    for fn in (model.histogram, model.gradients):
        assert np.allclose(total_over(pool, fn), fn(own), rtol=1e-9, atol=1e-9)
    by_id = {r.doc_id: r.score for r in quality(d, labels, rounds=2).collect()}
    score = model.score(*own)[2]
    assert all(abs(by_id[i] - s) < 1e-6 for i, s in zip(batch.column(0).to_pylist(), score))
