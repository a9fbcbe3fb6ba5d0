"""Quality classification by a generalised additive model with pairwise interactions.

Every text becomes a dozen numbers, each of them binned. Boosting goes round the features, fitting each time a tree
of a few leaves on one feature's bins and adding it to that feature's lookup table; then round the pairs that would
help most, on two features' bins. Scoring adds table entries by whole arrays. Features come from whole texts,
computed by array operations over bytes and word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _words as W
from tidemark.llm._common import labelled_sample, remainder, table

#: The most labelled documents that are learnt from.
MOST_LABELLED = 8000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_LEAF = 200, 100, 0.15, 4, 8
RIDGE = 1.0
THRESHOLD = 0.3

FEATURES = ("words", "word_bytes", "upper", "symbols", "symbol_ends", "digits", "beyond_ascii", "stops", "line_ends", "repeats", "distinct", "distinct_64", "single")


def _class_matrix() -> np.ndarray:
    """A row for each byte value: letters, upper case, symbols, digits, beyond ASCII, sentence ends, line ends."""
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    symbol = np.isin(b, list(b"#$%&*+/<=>@[\\]^_`{|}~!"))
    return np.stack([upper | lower, upper, symbol, digit, b >= 128, np.isin(b, list(b".,;:?!")), b == 10], axis=1).astype(np.float64)


_CLASSES = _class_matrix()
_SYMBOL = _CLASSES[:, 2].astype(bool)


def _distinct_within(h: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Mean share of distinct words over all windows of so many words of each text, or of the whole text if it has fewer.

    A word is the first of its kind in the windows that start after its last occurrence before."""
    order, before = np.argsort(h, kind="stable"), np.full(len(h), -1, np.int64)
    again = h[order[1:]] == h[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    n = np.diff(bounds)
    own = np.minimum(n, size)
    start, end, width, at = np.repeat(bounds[:-1], n), np.repeat(bounds[1:], n), np.repeat(own, n), np.arange(len(h))
    windows = np.minimum(at, end - width) - np.maximum(np.maximum(before + 1, at - width + 1), start) + 1
    counted = np.concatenate([[0], np.cumsum(np.maximum(windows, 0))])
    return np.diff(counted[bounds]) / np.maximum((n - own + 1) * own, 1)


def features(column: pa.Array) -> np.ndarray:
    """FEATURES of each text of a string column."""
    offsets, data = W.buffers(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j, (s, e, h), bounds in W.documents(column, spans=True):
        hist = np.stack([np.bincount(data[offsets[r] : offsets[r + 1]], minlength=256) for r in range(i, j)])
        letters, upper, symbols, digits, beyond, stops, lines = (hist @ _CLASSES).T
        size, n = np.maximum(hist.sum(axis=1), 1), np.diff(bounds)
        many = np.maximum(n, 1)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        same = np.zeros(len(h), bool)
        same[1:] = h[1:] == h[:-1]
        same[bounds[:-1][n > 0]] = False
        distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        within = _distinct_within(h, bounds, 64)
        ends = _SYMBOL[data[e - 1]] if len(e) else np.zeros(0, bool)
        out[i:j] = np.stack(
            [np.log1p(n), sums(e - s) / many, upper / np.maximum(letters, 1), symbols / size, sums(ends) / many, digits / size, beyond / size, stops / many, lines / many, sums(same) / many, distinct / many, within, sums(e - s == 1) / many], axis=1
        )
    return out


@dataclass
class AdditiveModel:
    edges: list = field(default_factory=list)  # bin edges of each feature
    prior: float = 0.0
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (feature, feature, table over PAIR_BINS x PAIR_BINS)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.prior)
        for k, t in enumerate(self.tables):
            z += t[b[:, k]]
        for i, j, t in self.pairs:
            z += t[_coarse(b[:, i], self.edges[i]), _coarse(b[:, j], self.edges[j])]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _coarse(b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // (len(edges) + 1)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf values over bins in order: the bins are split where that gains most, until there are `leaves` runs."""

    def best(a: int, b: int) -> tuple[float, int]:
        gs, hs, ns = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
        if b - a < 2:
            return 0.0, a
        gain = gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE) - gs[-1] ** 2 / (hs[-1] + RIDGE)
        gain[(ns[:-1] < LEAST_LEAF) | (ns[-1] - ns[:-1] < LEAST_LEAF)] = 0
        k = int(np.argmax(gain))
        return float(gain[k]), a + k + 1

    runs = [(0, len(g), *best(0, len(g)))]
    while len(runs) < leaves:
        k = max(range(len(runs)), key=lambda i: runs[i][2])
        a, b, gain, at = runs[k]
        if gain <= 1e-9:
            break
        runs[k : k + 1] = [(a, at, *best(a, at)), (at, b, *best(at, b))]
    out = np.zeros(len(g))
    for a, b, _, _ in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree that cuts one feature and then, on either side, the other; and its gain."""
    best, found = 0.0, np.zeros_like(g)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            values, gain = np.zeros_like(a), 0.0
            for side in (slice(0, cut), slice(cut, None)):
                gs, hs = np.cumsum(a[side].sum(axis=0)), np.cumsum(b[side].sum(axis=0))
                each = gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE)
                k = int(np.argmax(each))
                gain += each[k]
                values[side, : k + 1] = gs[k] / (hs[k] + RIDGE)
                values[side, k + 1 :] = (gs[-1] - gs[k]) / (hs[-1] - hs[k] + RIDGE)
            if gain > best:
                best, found = float(gain), values.T if flip else values
    return found, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Without labels, or with one label only, every score is near the labels' mean (0.5 without any)."""
    m = AdditiveModel()
    p = (y.sum() + 0.5) / (len(y) + 1)
    m.prior = float(np.log(p / (1 - p)))
    if len(np.unique(y)) < 2:
        return m
    m.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    b = m.bins(x)
    z = np.full(len(y), m.prior)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, t in enumerate(m.tables):
            g, h = slopes()
            own = b[:, k]
            step = RATE * _tree(np.bincount(own, g, len(t)), np.bincount(own, h, len(t)), np.bincount(own, minlength=len(t)), LEAVES)
            t += step
            z += step[own]
    cells = [_coarse(b[:, k], e) for k, e in enumerate(m.edges)]
    square = lambda v, i, j: np.bincount(cells[i] * PAIR_BINS + cells[j], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = sorted(((-_pair_tree(square(g, i, j), square(h, i, j))[1], i, j) for i in range(len(cells)) for j in range(i)))[:PAIRS]
    m.pairs = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in gains]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in m.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(square(g, i, j), square(h, i, j))[0]
            t += step
            z += step[cells[i], cells[j]]
    return m


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 5, held: int = 0, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    sample = labelled_sample(docs, labels, label, remainder(F.col("doc_id"), fold) != held, most, id_col, text_col).select("doc_id", "y", "text")
    kind = dict(sample.dtypes)["doc_id"]
    # numbers for at most `most` documents, and no texts
    rows = sorted((r["doc_id"], r["y"], tuple(r["x"])) for r in sample.mapInArrow(_extract, f"doc_id {kind}, y int, x array<double>").collect())
    return fit(np.array([r[2] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([float(r[1] > 0) for r in rows]))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.value.scores(features(batch.column("text")))
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(score)], [*rest, "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", fold: int = 5, held: int = 0, most: int = MOST_LABELLED) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 if score >= THRESHOLD).

    Learns from at most `most` labelled rows of labels whose fold isn't the held one; text alone is scored. Null and
    empty texts get the score of a text without words. Repeated rows get equal scores. Other columns are ignored. An
    empty table gives an empty result; without labels every score is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, label, fold, held, most, id_col, text_col))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = plain.mapInArrow(_score(model), f"doc_id {dict(plain.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", (remainder(F.col("doc_id"), fold) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with all their columns, that quality_scores predicts as 1."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col=id_col, text_col=text_col, **how))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = model.value.scores(features(batch.column(at))) >= THRESHOLD
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
