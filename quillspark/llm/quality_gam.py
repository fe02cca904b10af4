"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few numeric features; each feature is cut into quantile bins. Boosting goes round
the features in turn, each time fitting a shallow tree (at most three cuts) to the bins' gradients
and adding it to the feature's lookup table; then the pairs that reduce the remaining loss most get
tables of their own in the same way (one cut on either side). A score is the sum of one table entry per term,
so a batch is scored by bin lookups and additions.

The model is fitted on the driver on at most ``max_labels`` labelled rows (those with the smallest
hash of their id); everything else covers all rows. Labels of held-out rows are never read into it.
Without labels every score is 0.5. Null and empty texts have zero features and are scored like any
other. Rows with a null id or label are not trained on; repeated labels and
repeated rows of one id count once (the least of each).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import tidied, tune
from .quality_rules import measure_rows

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "alpha", "digits", "points", "distinct", "line_words")
MAX_LABELS = 20_000
BINS = 32
ROUNDS, RATE = 150, 0.1
PAIRS, PAIR_ROUNDS = 6, 60
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_POINT = np.zeros(256, dtype=bool)
_POINT[list(b"!?.,;:\"'()-_/\\@~^=+[]{}`")] = True


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a UTF-8 buffer."""
    m = measure_rows(data, offsets)
    n_words, size = m["n_words"], np.maximum(np.diff(offsets), 1)
    words = K.Words(data, offsets)
    row = words.row_of_word()
    # distinct words of a row: a key is unique to (row, word); count each by its first place
    h = K.mix(words.hashes() ^ (row.astype(np.uint64) << np.uint64(40)))
    _, first = np.unique(h, return_index=True)
    distinct = np.bincount(row[first], minlength=len(n_words)) if len(first) else np.zeros(len(n_words))
    per_word = np.maximum(n_words, 1)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data], dtype=np.int64)])
    points = np.concatenate([[0], np.cumsum(_POINT[data], dtype=np.int64)])
    return np.column_stack([
        np.log1p(n_words),
        m["word_chars"] / per_word,
        m["n_symbols"] / per_word,
        m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        m["n_repeat_words"] / per_word,
        m["n_upper"] / np.maximum(m["n_alpha"], 1),
        m["n_alpha"] / size,
        np.diff(digits[offsets]) / size,
        np.diff(points[offsets]) / per_word,
        distinct / per_word,
        np.log1p(n_words / np.maximum(m["n_lines"], 1)),
    ]).astype(np.float64)


@dataclass
class Model:
    """cuts: inner bin edges of each feature; tables: per feature; pairs: (i, j, 2-d table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def margin(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for k, t in enumerate(self.tables):
            out += t[b[:, k]]
        for i, j, t in self.pairs:
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def _leaf(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return -g / (h + 1.0), g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Value of each bin from a tree of cuts between bins."""
    value, gain = _leaf(g.sum(), h.sum())
    if depth == 0 or len(g) < 2:
        return np.full(len(g), value)
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _leaf(left_g, left_h)[1] + _leaf(g.sum() - left_g, h.sum() - left_h)[1]
    cut = int(gains.argmax())
    if gains[cut] <= gain + 1e-9:
        return np.full(len(g), value)
    return np.concatenate([_tree(g[: cut + 1], h[: cut + 1], depth - 1), _tree(g[cut + 1 :], h[cut + 1 :], depth - 1)])


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best pair of cuts of a 2-d histogram: each cell's value, and the gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c: np.ndarray) -> list[np.ndarray]:
        a = c[:-1, :-1]
        top, left, all_ = c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [a, top - a, left - a, all_ - top - left + a]

    pairs = list(zip(parts(cg), parts(ch)))
    if not pairs[0][0].size:
        return np.zeros_like(g), 0.0
    gains = sum(_leaf(x, y)[1] for x, y in pairs)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    v = [_leaf(x[i, j], y[i, j])[0] for x, y in pairs]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gains[i, j] - _leaf(g.sum(), h.sum())[1])


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    width = len(FEATURES)
    if not len(y):
        return Model(0.0, [np.zeros(0)] * width, [np.zeros(1)] * width, [])
    cuts = []
    for k in range(width):
        edges = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(edges[edges > x[:, k].min()])
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Model(float(np.log(share / (1 - share))), cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    b = model.bins(x)
    f = model.margin(b)

    def gradients() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = gradients()
            step = RATE * _tree(np.bincount(b[:, k], g, len(t)), np.bincount(b[:, k], h, len(t)))
            t += step
            f += step[b[:, k]]
    ranked = []
    g, h = gradients()
    flat = {}
    for i, j in combinations(range(width), 2):
        shape = (len(model.tables[i]), len(model.tables[j]))
        flat[i, j] = b[:, i] * shape[1] + b[:, j]
        n = shape[0] * shape[1]
        ranked.append((-_cross(np.bincount(flat[i, j], g, n).reshape(shape), np.bincount(flat[i, j], h, n).reshape(shape))[1], i, j))
    model.pairs = [(i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))) for gain, i, j in sorted(ranked)[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = gradients()
            step = RATE * _cross(np.bincount(flat[i, j], g, t.size).reshape(t.shape), np.bincount(flat[i, j], h, t.size).reshape(t.shape))[0]
            t += step
            f += step.ravel()[flat[i, j]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Fit on at most ``max_labels`` labelled documents that are not held out."""
    tune(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labels)
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).join(F.broadcast(known), "_id").select("_id", "_y", "_text")

    def run(batches):
        for b in batches:
            data, offsets = K.buffers(b.column(2))
            for i, j in K.slices(offsets):
                x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(x[:, k]) for k in range(len(FEATURES)))], names=["_id", "_y", *FEATURES])

    found = rows.mapInArrow(tidied(run), "_id bigint, _y int, " + ", ".join(f"{f} double" for f in FEATURES))
    one = found.groupBy("_id").agg(F.min(F.struct("_y", *FEATURES)).alias("r")).select("_id", "r.*")  # an id that many rows share is one row of the sample
    got = one.toPandas().sort_values("_id", kind="stable")
    return fit(got[list(FEATURES)].to_numpy(np.float64), got["_y"].to_numpy(np.float64))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    tune(docs.sparkSession)

    def run(batches):
        for b in batches:
            data, offsets = K.buffers(b.column(1))
            for i, j in K.slices(offsets):
                s = model.score(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("_text")).mapInArrow(tidied(run), "doc_id bigint, score double")


def query(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    out = scores(docs, train(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
