"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

The trees are trained with numpy on a bounded sample of labelled documents (`TRAIN_ROWS`), then
flattened into arrays of split features, thresholds and leaf values; all trees of all rows of a
batch are traversed at once, one numpy step per level.

Null and empty texts have statistics (all zero) and so a score; a label is null-safe: rows without
a doc_id or a label, and labels of unknown documents, teach nothing; a document labelled several
times counts once, with the mean of its labels.  Without any labelled row every score is 0.5, with
labels of one kind only every score is near that label."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import HELD_OUT_FOLD, Workspace, fold, held_out

#: Labelled documents that the trees are trained on, at most about this many.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 120, 4, 64, 0.12, 2.0, 12
THRESHOLD = 0.3

_CLASSES = ("other", "space", "newline", "digit", "upper", "lower", "beyond", "symbol", "bar", "stop", "comma", "quote")
_CLASS = np.zeros(256, np.uint8)
for _name, _members in (
    ("space", b" \t\x0b\x0c\r"), ("newline", b"\n"), ("digit", b"0123456789"), ("upper", bytes(range(65, 91))),
    ("lower", bytes(range(97, 123))), ("beyond", bytes(range(128, 256))), ("symbol", b"#*$%&@^~"), ("bar", b"|<>{}\\"),
    ("stop", b".!?"), ("comma", b",;:"), ("quote", b"\"'()[]"),
):
    _CLASS[list(_members)] = _CLASSES.index(_name)

#: Statistics of a text, in the order of the feature vector.
FEATURES = (
    "log_words", "word_bytes", "line_words", "distinct_words", "adjacent_repeats", "repeated_windows",
    *(f"{c}_per_word" for c in _CLASSES if c not in ("space", "newline")),
)


def _class_counts(data: np.ndarray) -> np.ndarray:
    step = 1 << 20
    return sum(
        (np.bincount(_CLASS[data[lo : lo + step]], minlength=len(_CLASSES)) for lo in range(0, len(data), step)),
        np.zeros(len(_CLASSES), np.int64),
    )


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text.  Whole texts; memory is that of a text's word hashes."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, part in shingles.pieces(texts):
        data, offsets = shingles.text_bytes(part)
        words, first = shingles.word_hashes(data, offsets)
        windows, begin = shingles.shingle_hashes(words, first, 3)
        for i in range(len(part)):
            n = int(first[i + 1] - first[i])
            counts = _class_counts(data[offsets[i] : offsets[i + 1]])
            own = words[first[i] : first[i + 1]]
            repeats = int((own[1:] == own[:-1]).sum())
            sorted_words = np.sort(own)
            distinct = int((sorted_words[1:] != sorted_words[:-1]).sum()) + (n > 0)
            sorted_windows = np.sort(windows[begin[i] : begin[i + 1]])
            again = int((sorted_windows[1:] == sorted_windows[:-1]).sum())
            per = 1.0 / max(n, 1)
            visible = counts.sum() - counts[_CLASSES.index("space")] - counts[_CLASSES.index("newline")]
            kinds = [counts[k] * per for k, c in enumerate(_CLASSES) if c not in ("space", "newline")]
            out[lo + i] = (
                np.log1p(n), visible * per, n / (1.0 + counts[_CLASSES.index("newline")]), distinct * per,
                repeats * per, again / max(1, len(sorted_windows)), *kinds,
            )
    return out


# ---------------------------------------------------------------------------------- training


@dataclass
class Trees:
    """All trees in heap order: node k of a tree has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; +inf sends every row left
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        if not len(self.feature):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        row, shift = np.arange(len(x))[:, None], np.arange(trees) * inner
        feature, threshold = self.feature.reshape(-1), self.threshold.reshape(-1)
        for _ in range(int(np.log2(inner + 1))):
            node = at + shift
            at = 2 * at + 1 + (x[row, feature[node]] > threshold[node])
        leaves = self.value.reshape(-1)[at - inner + np.arange(trees) * (inner + 1)]
        return 1 / (1 + np.exp(-(self.base + leaves.sum(1))))


def _best_splits(bins, node, nodes, grad, hess, n_bins):
    """For each node the best (gain, feature, bin) by histograms of gradients."""
    best = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, -1)
    for f in range(bins.shape[1]):
        key = node * n_bins + bins[:, f]
        g = np.bincount(key, grad, nodes * n_bins).reshape(nodes, n_bins).cumsum(1)
        h = np.bincount(key, hess, nodes * n_bins).reshape(nodes, n_bins).cumsum(1)
        c = np.bincount(key, minlength=nodes * n_bins).reshape(nodes, n_bins).cumsum(1)
        gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
        gain = g**2 / (h + RIDGE) + (gt - g) ** 2 / (ht - h + RIDGE) - gt**2 / (ht + RIDGE)
        gain[(c < LEAST) | (ct - c < LEAST)] = 0
        at = gain.argmax(1)
        top = gain[np.arange(nodes), at]
        better = top > best[0] + 1e-9
        best[0][better], best[1][better], best[2][better] = top[better], f, at[better]
    return best


def train(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss with quantile bins; the same rows give the same trees."""
    inner = 2**DEPTH - 1
    none = Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not len(y):
        return none
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    features, thresholds, values = [], [], []
    margin = np.full(len(y), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        at, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            start, nodes = 2**level - 1, 2**level
            gain, f, b = _best_splits(bins, at - start, nodes, grad, hess, BINS)
            go = np.zeros(len(y), np.int64)
            for k in np.flatnonzero(gain > 0):
                if b[k] < len(cuts[f[k]]):
                    feature[start + k], threshold[start + k] = f[k], cuts[f[k]][b[k]]
                    here = at == start + k
                    go[here] = bins[here, f[k]] > b[k]
            at = 2 * at + 1 + go
        leaf = at - inner
        value = -RATE * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + RIDGE)
        margin += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(base, np.stack(features), np.stack(thresholds), np.stack(values))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Trees from the labelled documents (doc_id, text) outside the held-out fold.

    Of all labelled documents about `rows` are taken, by a hash of doc_id; their statistics, not
    their texts, come to the driver."""
    work = Workspace(docs.sparkSession)
    usable = (
        labels.select("doc_id", F.col(label).cast("double").alias("_y"))
        .filter(F.col("_y").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg(F.avg("_y").alias("_y"))
    )
    usable = work.keep(usable)
    share = min(1.0, rows / max(1, usable.count()))
    chosen = work.keep(usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share * (1 << 20)))

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(list(statistics(texts)), pa.list_(pa.float64()))

    sample = (
        docs.select("doc_id", "text")
        .join(chosen, "doc_id")
        .select("doc_id", (F.col("_y") >= 0.5).cast("double").alias("y"), measured("text").alias("x"))
        .toArrow()
        .sort_by("doc_id")
    )
    x = np.asarray(sample["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return train(x, np.asarray(sample["y"].combine_chunks()))


def score(trees: Trees, text: Column) -> Column:
    """Probability of label 1 for the text of each row."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(trees.score(statistics(texts)), pa.float64())

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of the documents."""
    trees = fit(docs, labels, label)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(trees, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject."""
    return docs.filter(score(fit(docs, labels, label), F.col("text")) >= threshold)
