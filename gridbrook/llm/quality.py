"""Quality classifier by co-training of two views of a document.

The content view has the shape of the whole text, the metadata view its language, source and length.  Both are
naive Bayes over binned features, so a model is a table of counts of bounded size and a round is one pass over
all documents: labelled rows give counts for both views; of the others, those that one view is sure of give
counts to the other view.  What a view is sure of, and its calibration after the rounds, are read off the labelled
rows' scores; each of those is scored by a view that was fitted without the row's fold.  The calibrated log-odds are
added.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridbrook.llm.shared import drop, free_name, in_batches, save

BINS, ROUNDS, SURE, KEEP_FROM, PSEUDO_WEIGHT, FOLDS = 16, 3, 0.95, 0.5, 0.25, 5
#: Numbers of bins of the metadata features: language, source, length.
META = (64, 256, 32)
GRID = np.linspace(-20, 20, 81)
_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower or other letters, 3 digits, 4 white space, 5 the rest
_CLASS[0x21:0x80] = 5
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
SHAPES = 12
_SIGNED = re.compile(rb"[^\sA-Za-z0-9\x80-\xff]{2,}(?=\s|$)")


def shape(text: str | None) -> list[int]:
    """Bins of the SHAPES content features of a whole text, as places in the view's table."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    kinds = _CLASS[np.frombuffer(raw, np.uint8)]
    count = np.bincount(kinds, minlength=6)
    words, lines = raw.split(), raw.split(b"\n")
    n, letters = max(1, len(words)), max(1, int(count[1] + count[2]))
    common = Counter(words)
    double = int(((kinds[1:] == 5) & (kinds[:-1] == 5)).sum())
    size = max(1, len(raw))
    ratios = [
        count[1] / letters, count[5] / size, count[3] / size, count[4] / size, len(common) / n, double / size,
        1 - len(set(lines)) / len(lines), len(_SIGNED.findall(raw)) / n, common.most_common(1)[0][1] / n if words else 1.0,
    ]
    sizes = [len(words), letters / n, size / len(lines)]
    bins = [min(BINS - 1, int(BINS * max(0.0, min(1.0, float(r))) ** 0.5)) for r in ratios] + [min(BINS - 1, int(np.log2(1 + s))) for s in sizes]
    return [BINS * i + b for i, b in enumerate(bins)]


def _meta():
    a, b, c = META
    length = F.least(F.lit(c - 1), F.floor(F.log2(1 + F.greatest(F.lit(0), F.coalesce(F.col("n_chars").cast("long"), F.lit(0)))) * 2)).cast("int")
    return F.array(F.pmod(F.xxhash64("lang"), F.lit(a)).cast("int"), (a + F.pmod(F.xxhash64("source"), F.lit(b))).cast("int"), a + b + length)


class View:
    """Naive Bayes over one feature bin of each group."""

    def __init__(self, counts: np.ndarray, groups: int):
        smooth = counts + 0.5
        self.table = np.log(smooth[:, 1] / smooth[:, 1].sum()) - np.log(smooth[:, 0] / smooth[:, 0].sum())
        total = counts.sum(axis=0) / groups + 1
        self.prior = float(np.log(total[1] / total[0]))

    def score(self, bins: np.ndarray) -> np.ndarray:
        return np.clip(self.table[bins].sum(axis=1) + self.prior, -19.9, 19.9)


def _cell(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.searchsorted(GRID, scores) - 1, 0, len(GRID) - 2)


class Model:
    """Both views with their calibration; None where the labels don't have both classes."""

    def __init__(self, views: list[View], lines: list[tuple[float, float]], prior: float):
        self.views, self.lines, self.prior = views, lines, prior

    def score(self, bins: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [a * v.score(b) + c for v, b, (a, c) in zip(self.views, bins, self.lines)]
        return own[0], own[1], 1 / (1 + np.exp(-(own[0] + own[1] - self.prior)))


def _calibrated(hist: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the log-odds of class 1 given the score, from counts (cell, class)."""
    x, n, y = (GRID[:-1] + GRID[1:]) / 2, hist.sum(axis=1), hist[:, 1]
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([((y - n * p) * x).sum() - 0.01 * a, (y - n * p).sum() - 0.01 * c])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, c = a + step[0], c + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(c)) if a > 0 else (0.0, float(np.log((y.sum() + 1) / (n.sum() - y.sum() + 1))))


def _features(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            bins = pa.array([shape(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), bins, batch.column(2)], ["doc_id", "t", "m"])

    have = set(docs.columns)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("lang", "source", "n_chars")))
    return in_batches(own.select("doc_id", "text", _meta().alias("m")), run, "doc_id long, t array<int>, m array<int>")


def _arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    out = []
    for name, k in (("t", SHAPES), ("m", len(META))):
        column = batch.column(batch.schema.get_field_index(name))
        out.append(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k))
    return out


def _fold(ids: pa.Array) -> np.ndarray:
    """Fold of each row by a hash of its id; rows without an id have no label and so no use for theirs."""
    known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.uint64)
    return ((known * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS


def _counted(rows: DataFrame, views: list[View] | None, apart: list[list[View]] | None = None) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """One pass: counts of labelled rows' features by fold, histograms of their scores by the views ``apart`` fitted without their fold, and features of other rows by giver's score cell."""
    sizes = (SHAPES * BINS, sum(META))
    empty = lambda: ([np.zeros((FOLDS * s, 2)) for s in sizes], [np.zeros((len(GRID) - 1, 2)) for _ in sizes], [np.zeros((s, len(GRID) - 1)) for s in sizes])

    def run(batches):
        own, hist, lent = empty()
        for batch in batches:
            bins = _arrays(batch)
            label = batch.column(batch.schema.get_field_index("y")).fill_null(-1).to_numpy(zero_copy_only=False)
            fold = _fold(batch.column(batch.schema.get_field_index("doc_id")))
            for v, b in enumerate(bins):
                for y in (0, 1):
                    np.add.at(own[v][:, y], (b + (fold * sizes[v])[:, None])[label == y].ravel(), 1)
                if views:
                    for f in range(FOLDS):
                        mine = (fold == f) & (label >= 0)
                        if mine.any():
                            np.add.at(hist[v], (_cell(apart[f][v].score(b[mine])), label[mine]), 1)
                    free = label < 0
                    cell = _cell(views[v].score(b[free]))
                    given = bins[1 - v][free]
                    np.add.at(lent[1 - v], (given.ravel(), np.repeat(cell, given.shape[1])), 1)
        cells = [(kind, v, int(i), int(j), float(a[i, j])) for kind, arrays in enumerate((own, hist, lent)) for v, a in enumerate(arrays) for i, j in zip(*np.nonzero(a))]
        yield pa.RecordBatch.from_pydict({k: pa.array([c[n] for c in cells], t) for n, (k, t) in enumerate([("kind", pa.int32()), ("v", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.float64())])})

    out = empty()
    cells = in_batches(rows, run, "kind int, v int, i int, j int, n double").groupBy("kind", "v", "i", "j").agg(F.sum("n"))
    for kind, v, i, j, n in cells.collect():  # at most FOLDS * sizes * 2 + sizes * 80 cells, whatever the input
        out[kind][v][i, j] = n
    return out


def _sure(hist: np.ndarray, up: bool) -> np.ndarray:
    """Cells beyond the score from which labelled rows have the class with a share of SURE at least."""
    good, bad = (hist[:, 1], hist[:, 0]) if up else (hist[::-1, 0], hist[::-1, 1])
    g, b = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    fine = (g >= SURE * (g + b)) & (g >= 5)
    out = np.zeros(len(hist), bool)
    if fine.any():
        out[int(np.argmax(fine)) :] = True
    return out if up else out[::-1]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model | None, DataFrame]:
    """The co-trained model and the table of features.  A document with several labels has the least of them."""
    known = labels.selectExpr("cast(doc_id as long) doc_id", "cast(quality as int) quality").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("y"))
    # rows without an id are dealt out by their features instead of meeting in one task
    told = _features(docs).withColumn("deal", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("t"), F.lit(1024))).otherwise(F.lit(0)))
    rows = save(told.join(known.withColumn("deal", F.lit(0).cast("long")), ["doc_id", "deal"], "left").drop("deal"), "features")
    folds = [x.reshape(FOLDS, -1, 2) for x in _counted(rows, None)[0]]
    own = [x.sum(axis=0) for x in folds]
    if own[0].sum(axis=0).min() == 0:
        return None, rows
    lent_to = [np.zeros_like(x) for x in own]
    for r in range(ROUNDS + 1):
        fitted = lambda held: [View(c + e - (0 if held is None else f[held]), k) for c, e, f, k in zip(own, lent_to, folds, (SHAPES, len(META)))]  # noqa: B023, E731
        views, apart = fitted(None), [fitted(f) for f in range(FOLDS)]
        _, hist, lent = _counted(rows, views, apart)
        if r < ROUNDS:
            lent_to = [PSEUDO_WEIGHT * np.column_stack([lent[v][:, _sure(hist[1 - v], False)].sum(axis=1), lent[v][:, _sure(hist[1 - v], True)].sum(axis=1)]) for v in (0, 1)]
    total = hist[0].sum(axis=0)
    return Model(views, [_calibrated(h) for h in hist], float(np.log(total[1] / total[0]))), rows


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content_logit, metadata_logit, score, keep of every document; a document with several labels has the least of them.

    score is the calibrated probability of good quality, keep is score >= 0.5.  Null and empty texts and null
    metadata are features like others; rows without an id have no label; repeated rows are repeated.  Without
    labels of both classes nothing is learnt: scores are null and all rows are kept.  Other columns are ignored.
    """
    model, rows = fit(docs, labels)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if model is None:
                a = b = p = [None] * n
                keep = [True] * n
            else:
                a, b, p = model.score(_arrays(batch))
                keep = p >= KEEP_FROM
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(batch.schema.get_field_index("doc_id")), "content_logit": pa.array(a, pa.float64()), "metadata_logit": pa.array(b, pa.float64()), "score": pa.array(p, pa.float64()), "keep": pa.array(keep, pa.bool_())})

    return in_batches(rows, run, "doc_id long, content_logit double, metadata_logit double, score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps; scored in one more pass, without a join."""
    model, rows = fit(docs, labels)
    drop(rows)
    if model is None:
        return docs
    at, width = docs.columns.index("text"), len(docs.columns)
    have = set(docs.columns)
    meta = docs.select("*", *(F.lit(None).cast("string").alias(c) for c in ("lang", "source", "n_chars") if c not in have))
    meta = meta.select(*docs.columns, _meta().alias(free_name(docs, "m")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                t = np.array([shape(x) for x in batch.column(at).to_pylist()], np.int32)
                m = batch.column(width).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(META))
                kept = pa.array(model.score([t, m])[2] >= KEEP_FROM)
                yield pa.RecordBatch.from_arrays(batch.columns[:width], batch.schema.names[:width]).filter(kept)

    return in_batches(meta, run, docs.schema)
