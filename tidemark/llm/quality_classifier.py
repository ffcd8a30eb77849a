"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are grown level by level on binned features and kept as flat arrays of complete binary trees, so that scoring
walks all trees of all rows at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, only, text_or_empty
from .kernels import chunks
from .textstats import Stretch

FEATURES = ("words", "word_size", "symbols", "marks", "upper", "digits", "stops", "dup_lines", "repeats", "distinct", "letters", "line_words")


def statistics(d: Stretch) -> np.ndarray:
    """One row per document, one column per name of FEATURES."""
    w, c = np.maximum(1, d.n_words), np.maximum(1, d.n_chars)
    lines = np.maximum(1, d.n_lines)
    return np.stack([np.log1p(d.n_words), d.word_chars / w, d.n_symbols / w, d.n_marks / w, d.n_upper / np.maximum(1, d.n_letters), d.n_digits / c, d.n_stops / w, d.n_dup_lines / lines, d.n_repeat_words / w, d.n_distinct / w, d.n_letters / c, d.n_words / lines], axis=1)


@dataclass(frozen=True)
class Forest:
    """Complete binary trees of one depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, depth = len(self.leaf), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        out = np.full(len(x), self.start)
        for a in range(0, len(x), 4096):
            part, t = x[a : a + 4096], np.arange(trees)
            node = np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                value = np.take_along_axis(part, self.feature[t, node], axis=1)
                node = 2 * node + 1 + (value > self.threshold[t, node])
            out[a : a + 4096] += self.leaf[t, node - (self.leaf.shape[1] - 1)].sum(axis=1) if trees else 0
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Forest:
    """Logistic loss, second-order gains over `bins` quantile bins; no split leaves fewer than `least` rows."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 1)), float(np.log(p / (1 - p))))
    width = x.shape[1]
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin, inner = np.full(len(y), start), 2**depth - 1
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = (node - first)[:, None] * bins + binned + np.arange(width) * (n * bins)
            sums = [np.bincount(at.ravel(), np.repeat(v, width), width * n * bins).reshape(width, n, bins).cumsum(axis=2) for v in (g, h, np.ones(len(y)))]
            (gl, hl, cl), (gt, ht, ct) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < least) | (ct - cl < least)] = 0
            for k, e in enumerate(edges):
                gain[k, :, len(e) :] = 0
            best = gain.transpose(1, 0, 2).reshape(n, -1)
            pick = best.argmax(axis=1)
            for q in np.flatnonzero(best[np.arange(n), pick] > 1e-9):
                k, b = divmod(int(pick[q]), bins)
                feature[first + q], threshold[first + q] = k, edges[k][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + ridge)
        margin += leaf[slot]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.array(features), np.array(thresholds), np.array(leaves), start)


def held_out(doc_id) -> "F.Column":
    """Rows never learned from: crc32 of doc_id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, cut: float = 0.3) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted (1 if score >= cut).

    Learns from at most `sample_rows` labelled rows that are not held out, those of least hash of doc_id; scores every
    whole text, empty ones (null counts as empty) too. Labels of null or unknown doc_ids are not used; a repeated row
    is scored each time it occurs; with no labels, or labels of one kind, the score is their smoothed share. An empty
    docs gives no rows; extra columns are not read. The text is read once and never shuffled.
    """
    rows = text_or_empty(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))

    def measure(batches):
        for batch in batches:
            for first, stop, data, at in chunks(batch.column("text")):
                x = statistics(Stretch(data, at))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, stop - first), flat], ["doc_id", "x"])

    scratch = Scratch(docs.sparkSession, "quality_classifier")
    measured = scratch.put("measured", rows.mapInArrow(measure, "doc_id long, x array<double>"))
    known = only(labels, "doc_id", "quality").filter("quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample_rows)
    learned = measured.join(F.broadcast(sample), "doc_id").select("doc_id", "x", "quality")
    learned = learned.orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "x").limit(sample_rows).toPandas()
    x = np.array(learned["x"].tolist(), float).reshape(-1, len(FEATURES))
    forest = docs.sparkSession.sparkContext.broadcast(fit(x, learned["quality"].to_numpy(float)))

    def score(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.round(forest.value.score(x), 9))], ["doc_id", "score"])

    scored = measured.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
