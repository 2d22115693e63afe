"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are counted from the whole text alone. The trees are grown on the driver from a bounded
sample of labelled documents: at most max_sample, picked by a hash of doc_id, and never one that is
held out (crc32 of doc_id as text, modulo 5, is 0; a null doc_id counts as held out). Several labels
of one document: the mean decides, a half counts as 1; null labels are left out. The grown trees are
flattened into arrays of a fixed size and travel with the tasks; scores are sums of leaves found by
vectorised traversal.

Null text: scored as the empty text. Empty documents: no rows. No labels to learn from: every score is
0.5. Repeated rows are scored alike; equal features score alike. Very long texts are counted whole.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, record_batch, slices, stored, texts_of
from .textstats import Stats

FEATURES = "doc_id long, features array<float>"
RESULT = "doc_id long, score double"


class Boosted:
    """Trees of one depth, each a row of split features, thresholds and leaf values."""

    def __init__(self, depth: int = 4) -> None:
        self.depth, self.base = depth, 0.0
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.cut = np.zeros((0, 2**depth - 1), np.float32)
        self.leaf = np.zeros((0, 2**depth), np.float64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, *, rounds: int = 80, rate: float = 0.1, bins: int = 32, smooth: float = 1.0, least: float = 5.0) -> Boosted:
        """Newton boosting of the logistic loss; splits are searched in histograms of quantile bins."""
        if not len(y):
            return self
        n, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(width)]
        binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)])
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        score, inner = np.full(n, self.base), 2**self.depth - 1
        features, cuts, leaves = [], [], []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            node, feature, cut = np.zeros(n, np.int64), np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                at = (node - first) * bins
                gains = np.full((width, count, bins), -np.inf)
                for f in range(width):
                    key = at + binned[f]
                    gl = np.bincount(key, g, count * bins).reshape(count, bins).cumsum(axis=1)
                    hl = np.bincount(key, h, count * bins).reshape(count, bins).cumsum(axis=1)
                    gr, hr = gl[:, -1:] - gl, hl[:, -1:] - hl
                    gain = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - gl[:, -1:] ** 2 / (hl[:, -1:] + smooth)
                    gain[(hl < least) | (hr < least)] = -np.inf
                    gain[:, len(edges[f]) :] = -np.inf
                    gains[f] = gain
                flat = gains.transpose(1, 0, 2).reshape(count, -1)
                best = flat.argmax(axis=1)
                for k in np.flatnonzero(flat[np.arange(count), best] > 1e-6):
                    f, b = divmod(int(best[k]), bins)
                    feature[first + k], cut[first + k] = f, edges[f][b]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            end = node - inner
            leaf = -rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + smooth)
            score += leaf[end]
            features.append(feature), cuts.append(cut), leaves.append(leaf)
        self.feature, self.cut, self.leaf = np.stack(features), np.stack(cuts), np.stack(leaves)
        return self


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def document_features(docs: DataFrame) -> DataFrame:
    """The statistics of each document; columns as in FEATURES."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield record_batch(FEATURES, {"doc_id": batch.column("doc_id"), "features": [np.array(Stats(t).features(), np.float32) for t in texts_of(batch)]})

    docs = own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(count, FEATURES)


def train(features: DataFrame, labels: DataFrame, *, label: str = "quality", max_sample: int = 20_000, seed: int = 13) -> Boosted:
    """Trees from at most max_sample labelled documents that aren't held out."""
    marked = own_columns(labels, "doc_id", label).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(label) >= 0.5).cast("int").alias("y")).where(~held_out())
    marked = stored(marked.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).orderBy("h", "doc_id").limit(max_sample), "labels")
    # max_sample rows of three numbers: the features of all other documents stay where they are
    rows = features.join(F.broadcast(marked), "doc_id").select("features", "y", "h", "doc_id").orderBy("h", "doc_id", F.xxhash64("features")).limit(max_sample).toArrow()
    if not rows.num_rows:
        return Boosted()
    x = np.array(rows["features"].to_pylist(), np.float32)
    return Boosted().fit(x, rows["y"].to_numpy().astype(np.float64))


def classify_quality(docs: DataFrame, labels: DataFrame, *, max_sample: int = 20_000) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 is likelier) of each document."""
    features = stored(document_features(docs), "features")
    model = train(features, labels, max_sample=max_sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), np.float32).reshape(batch.num_rows, -1)
            yield record_batch(RESULT, {"doc_id": batch.column("doc_id"), "score": model.probability(x)})

    return features.mapInArrow(score, RESULT)
