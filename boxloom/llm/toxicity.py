"""Toxicity by a chain of linear classifiers.

The label table's columns are predicted one after the other, the toxic one last. Each model
is logistic over hashed words (present or not); later ones also see the earlier categories'
log odds, in training those predicted out of fold, so that they learn from predictions as
uncertain as the ones they will get. A fold's predictions come from a model whose words were
chosen on the other folds alone.

Training takes at most ``sample`` labelled rows, those whose hashed id is smallest: a bound and
a parameter. The models' size is a parameter too: at most ``features`` words, those whose
presence tells most about the label and at least ``sure`` standard deviations. Scoring covers
every row and whole texts in one narrow pass. ``report`` gives precision and recall of the
out-of-fold predictions.

Null, empty and very short texts get the models' intercepts alone; very long ones are hashed in
blocks of their own. Without labelled rows, or with one class, a category's probability is its
share (0 without rows). Repeated rows are scored each. Labels of unknown ids and null labels
are skipped; repeated labels count once (the largest); where a labelled id has several texts,
the first in text order is learned from. Ties between words go to the smaller hash. Empty
tables give no rows. Other columns aren't read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import ALNUM_WORD, blocks, sliced, words_of

#: Defaults of the parameters: labelled rows to learn from, words of a model.
SAMPLE = 20_000
FEATURES = 4000
#: Standard deviations by which a word's toxic share must differ for it to be used.
SURE = 4.0
SPACE = 1 << 20
FOLDS = 4
SEED = 17
CUT = 0.5

#: Label columns in the chain's order.
CATEGORIES = ("quality", "toxic")


def _buckets(texts: pa.Array):
    """Distinct hashed words of each text, sorted."""
    for _, raw, offsets in blocks(texts):
        words, first = words_of(raw, offsets, ALNUM_WORD)
        cells = (words & np.uint64(SPACE - 1)).astype(np.int32)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield np.unique(cells[a:b])


def _sampled(batches):
    for batch in batches:
        cells = [c.tolist() for c in _buckets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cells, pa.list_(pa.int32()))], ["id", "labels", "cells"])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Sparse rows of ones, and dense columns beside them."""

    def __init__(self, lists: list[np.ndarray], width: int):
        self.size = np.array([len(x) for x in lists], np.int64)
        self.column = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.size)
        self.width = width

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], len(self.size))

    def back(self, error: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, error[self.row], self.width)


def fit(rows: Rows, extra: np.ndarray, label: np.ndarray, use: np.ndarray, rounds: int = 200, ridge: float = 1e-5):
    """(weights, weights of extra columns, intercept) by adaptive gradient steps on the rows in use."""
    n, share = max(int(use.sum()), 1), float(label[use].mean()) if use.any() else 0.0
    start = np.log(share / (1 - share)) if 0 < share < 1 else (-30.0 if share == 0 else 30.0)
    w, e, b = np.zeros(rows.width), np.zeros(extra.shape[1]), start
    if not 0 < share < 1:
        return w, e, b
    sw, se, sb = np.full(rows.width, 1e-8), np.full(len(e), 1e-8), 1e-8
    for _ in range(rounds):
        error = np.where(use, _sigmoid(rows.dot(w) + extra @ e + b) - label, 0.0) / n
        gw, ge, gb = rows.back(error) + ridge * w, extra.T @ error + ridge * e, error.sum()
        sw, se, sb = sw + gw**2, se + ge**2, sb + gb**2
        w -= 0.6 * gw / np.sqrt(sw)
        e -= 0.3 * ge / np.sqrt(se)
        b -= 0.3 * gb / np.sqrt(sb)
    return w, e, b


def chosen_words(cells: list[np.ndarray], label: np.ndarray, use: np.ndarray, features: int, sure: float) -> np.ndarray:
    """The cells whose presence tells most about the label in the rows in use, sorted."""
    count, bad = np.zeros(SPACE), np.zeros(SPACE)
    for c, t, u in zip(cells, label, use):
        if u:
            count[c] += 1
            bad[c] += t
    share = label[use].mean() if use.any() else 0.0
    tells = np.abs(bad - share * count) / np.sqrt(count * max(share * (1 - share), 1e-9) + 1)
    best = np.argsort(-tells, kind="stable")[:features]
    return np.sort(best[tells[best] >= sure])


def _rows(cells: list[np.ndarray], chosen: np.ndarray) -> Rows:
    place = np.full(SPACE, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    return Rows([p[p >= 0] for p in (place[c] for c in cells)], max(len(chosen), 1))


def train(cells: list[np.ndarray], labels: np.ndarray, names=CATEGORIES, features: int = FEATURES, sure: float = SURE) -> dict:
    """A chain: for each category its words and weights, and how its out-of-fold predictions fared (labels: -1 for none)."""
    n = len(cells)
    fold = np.arange(n) % FOLDS
    extra, models, report = np.zeros((n, 0)), [], {}
    for k, name in enumerate(names):
        label, known = (labels[:, k] > 0).astype(float), labels[:, k] >= 0
        out = np.zeros(n)
        for f in range(FOLDS):
            use = known & (fold != f)
            rows = _rows(cells, chosen_words(cells, label, use, features, sure))
            w, e, b = fit(rows, extra, label, use)
            out = np.where(fold == f, rows.dot(w) + extra @ e + b, out)
        chosen = chosen_words(cells, label, known, features, sure)
        models.append((chosen, fit(_rows(cells, chosen), extra, label, known)))
        said, true = known & (_sigmoid(out) >= CUT), known & (label > 0)
        report[name] = {"rows": int(known.sum()), "positive": int(true.sum()), "flagged": int(said.sum()), "right": int((said & true).sum())}
        extra = np.column_stack([extra, np.clip(out, -8, 8)])
    return {"models": models, "report": report, "names": tuple(names)}


def _scored(chain: dict):
    def run(batches):
        for batch in batches:
            cells, extra, cols = list(_buckets(batch.column(1))), np.zeros((batch.num_rows, 0)), []
            for chosen, (w, e, b) in chain["models"]:
                odds = _rows(cells, chosen).dot(w) + extra @ e + b
                cols.append(pa.array(_sigmoid(odds), pa.float64()))
                extra = np.column_stack([extra, np.clip(odds, -8, 8)])
            flag = pa.array(cols[-1].to_numpy() >= CUT, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, flag], ["id", *[f"p_{c}" for c in chain["names"]], chain["names"][-1]])

    return run


def training_rows(docs: DataFrame, labels: DataFrame, names, sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray]:
    """Cells and labels (-1: none) of at most ``sample`` labelled documents (id, text; id and the label columns)."""
    each = [F.coalesce(F.max(F.col(c).cast("int")), F.lit(-1)).alias(c) for c in names]
    labels = labels.where(F.col("id").isNotNull()).groupBy("id").agg(*each).where(" or ".join(f"`{c}` >= 0" for c in names))
    some = labels.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(sample).select("id", F.array(*names).alias("labels"))
    some = docs.join(F.broadcast(some), "id").groupBy("id", "labels").agg(F.min("text").alias("text")).select("id", "text", "labels")
    rows = some.mapInArrow(sliced(_sampled), "id long, labels array<int>, cells array<int>").toArrow().sort_by("id")
    cells = [np.asarray(c.values) for c in rows.column("cells")] if rows.num_rows else []
    return cells, np.array(rows.column("labels").to_pylist(), np.int64).reshape(-1, len(names))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, sample: int = SAMPLE, features: int = FEATURES, sure: float = SURE) -> dict:
    """The chain that ``classify`` applies; its "report" counts out-of-fold predictions by category."""
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), *categories)
    return train(*training_rows(pairs, marks, categories, sample), categories, features, sure)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", categories=CATEGORIES, sample: int = SAMPLE, features: int = FEATURES, sure: float = SURE) -> DataFrame:
    """One row per input row: id, a probability for each category, and the last category's verdict under its name."""
    chain = learn(docs, labels, id_col=id_col, text_col=text_col, categories=categories, sample=sample, features=features, sure=sure)
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return pairs.mapInArrow(sliced(_scored(chain)), f"id long, {', '.join(f'p_{c} double' for c in categories)}, {categories[-1]} boolean")
