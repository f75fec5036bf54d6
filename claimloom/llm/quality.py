"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

#: Labelled rows used for the fit at most: the smallest by hash of their id.
FIT_ROWS = 12_000

FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper", "digit", "punct", "high", "space", "lines", "distinct", "repeated_lines", "top_word",
    "hashes", "stars", "bangs", "pipes", "stops", "short_words", "byte_entropy", "mean_line", "repeated_pairs", "single_words",
]


def _statistics(text: bytes) -> list[float]:
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    w = text.split()
    k = max(1, len(w))
    counts = Counter(w)
    lines = [x for x in text.split(b"\n") if x]
    p = h[h > 0] / n
    upper, digit, space = h[65:91].sum(), h[48:58].sum(), h[9:14].sum() + h[32]
    high = h[128:].sum()
    letters = upper + h[97:123].sum()
    pairs = len(set(zip(w, w[1:], strict=False)))
    return [
        np.log1p(n), np.log1p(len(w)), (n - space) / k, upper / max(1, letters), digit / n, (n - letters - digit - space - high) / n, high / n, space / n,
        len(lines) / k, len(counts) / k, 1 - len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / k,
        h[35] / k, h[42] / k, h[33] / k, h[124] / k, h[46] / k, sum(len(x) < 4 for x in w) / k, float(-(p * np.log2(p)).sum()), np.log1p(n / max(1, len(lines))),
        1 - pairs / max(1, len(w) - 1) if len(w) > 1 else 0.0, sum(v == 1 for v in counts.values()) / k,
    ]


@dataclass
class Forest:
    """Complete trees of one depth in flat arrays: node i has the children 2i+1 and 2i+2."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and at[:1].size and at[0] < inner:  # all rows are on the same level
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += leaf[at - inner]
        return 1 / (1 + np.exp(-total))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.12, l2: float = 2.0, least: float = 4.0) -> Forest:
    """Newton boosting on log loss over quantile bins. Without rows, or with one class only, the
    forest is the smoothed rate of label 1."""
    inner, leaves = 2**depth - 1, 2**depth
    rate1 = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate1 / (1 - rate1)))
    none = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    if len(y) < 2 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)  # v > cut[k]: bin > k
    d = x.shape[1]
    offset = np.arange(d) * bins
    total, fs, cs, ls = np.full(len(y), base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        f, c, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((at - first)[:, None] * (d * bins) + offset + binned).ravel()
            gs = np.bincount(slot, np.repeat(g, d), width * d * bins).reshape(width, d, bins)
            hs = np.bincount(slot, np.repeat(h, d), width * d * bins).reshape(width, d, bins)
            gl, hl = gs.cumsum(2)[:, :, :-1], hs.cumsum(2)[:, :, :-1]
            gt, ht = gs.sum(2)[:, :1, None], hs.sum(2)[:, :1, None]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(width, -1).argmax(1)
            for node in range(width):
                k, b = divmod(int(best[node]), bins - 1)
                if gain[node, k, b] > 1e-6 and b < len(cuts[k]):
                    f[first + node], c[first + node] = k, cuts[k][b]
            at = 2 * at + 1 + (x[np.arange(len(y)), f[at]] > c[at])
        leaf = at - inner
        value = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        total += value[leaf]
        fs.append(f), cs.append(c), ls.append(value)
    return Forest(np.array(fs), np.array(cs), np.array(ls), base)


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, x array<double>) over whole texts; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, x array<double>")


def sample_labels(labels: DataFrame, column: str, modulus: int, remainder: int, rows: int) -> DataFrame:
    """Up to rows labelled ids outside the held-out fold, one row an id, chosen by hash of the id."""
    free = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    one = free.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Forest:
    """The forest, fitted on the driver on at most rows x 22 numbers of bounded, labelled rows."""
    picked = F.broadcast(sample_labels(labels, "quality", 5, 0, rows))  # at most rows ids
    some = docs.select(F.col("doc_id").cast("long"), "text").join(picked, "doc_id")
    y = some.select("doc_id", "text").transform(statistics).join(picked, "doc_id").select("doc_id", "y", "x").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.array(y.x.tolist(), float).reshape(len(y), len(FEATURES))
    return fit_forest(x, y.y.to_numpy(float))


def score_quality(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, score) of each whole text, by its statistics alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([_statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in b.column(1)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forest.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, score double")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns; one pass, no shuffle.

    Null doc_ids are scored as others are; empty and null texts get the score of empty statistics.
    """
    forest, schema, names = fit_quality(docs, labels, rows), docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for b in batches:
            x = np.array([_statistics(t.as_py().encode() if t.is_valid else b"") for t in b.column(at)], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(forest.score(x) >= threshold))

    return docs.mapInArrow(run, schema)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
