"""Quality classifier: a generalised additive model with pairwise interactions.

Features of each whole text come from one vectorised pass over its bytes and words.
They are cut into bins at quantiles; boosting goes round the features in turn and fits a
shallow tree to the gradient per bin, which adds to that feature's lookup table.  Then
the pairs of features with the largest remaining gain get tables of their own.  A score
is the sum of table entries, so scoring is a few vectorised lookups.

The model is fitted on at most ``sample`` labelled rows, those with the smallest hash of
their id; everything else covers all rows.

Cases: null and empty texts have all features at zero and a score like any other text;
rows without a label are scored only; several labels of one id are averaged; of a repeated
id the row with the smallest features is learnt from; without any label the score is 0.5, with labels of one kind only it is their smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LOWER, U64, blocks, grams, words_of
from .workspace import Workspace, small_batches

FEATURES = (
    "log_words", "word_length", "upper", "odd_symbols", "exclamations", "pipes", "digits", "stops_commas", "non_ascii",
    "line_words", "short_words", "long_words", "odd_word_ends", "repeated_grams", "repeated_words", "letters",
)


@dataclass
class GamConfig:
    sample: int = 20_000
    bins: int = 48
    rounds: int = 120
    pair_rounds: int = 40
    pairs: int = 6
    pair_bins: int = 8
    rate: float = 0.15
    seed_column: str = "doc_id"


@dataclass
class Gam:
    """Bin edges and lookup tables; small whatever the input."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for k, (edge, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edge, x[:, k])]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[i], x[:, i]), np.searchsorted(self.pair_edges[j], x[:, j])]
        return 1 / (1 + np.exp(-total))


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton steps of a depth-limited tree over ordered bins."""
    out = np.empty(len(g))
    todo = [(0, len(g), depth)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while todo:
        a, b, left = todo.pop()
        sg, sh = cg[b] - cg[a], ch[b] - ch[a]
        cut = np.arange(a + 1, b)
        if left and len(cut):
            lg, lh = cg[cut] - cg[a], ch[cut] - ch[a]
            gain = lg**2 / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg**2 / (sh + 1)
            gain[(lh < 1e-9) | (sh - lh < 1e-9)] = 0
            k = int(np.argmax(gain))
            if gain[k] > 1e-9:
                todo += [(a, int(cut[k]), left - 1), (int(cut[k]), b, left - 1)]
                continue
        out[a:b] = sg / (sh + 1)
    return out


def _sums(cell: np.ndarray, n: int, y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(cell, y - p, n), np.bincount(cell, p * (1 - p), n)


def _grid(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best four-leaf tree on a grid: one cut of the first axis, one of the second on each side."""
    best, out = 0.0, np.full(g.shape, g.sum() / (h.sum() + 1))
    for k in range(1, len(g)):
        sides = [(g[:k].sum(0), h[:k].sum(0)), (g[k:].sum(0), h[k:].sum(0))]
        leaf = [_tree(a, b, 1) for a, b in sides]
        gain = sum(float((v * a).sum()) for v, (a, _) in zip(leaf, sides))
        if gain > best:
            best, out = gain, np.concatenate([np.tile(leaf[0], (k, 1)), np.tile(leaf[1], (len(g) - k, 1))])
    return best, out


def fit(x: np.ndarray, y: np.ndarray, c: GamConfig) -> Gam:
    """Cyclic boosting on a bounded sample."""
    model = Gam()
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    quantiles = lambda n: [np.unique(np.quantile(col, np.linspace(0, 1, n + 1)[1:-1])) for col in x.T]
    model.edges, model.pair_edges = quantiles(c.bins), quantiles(c.pair_bins)
    cells = [np.searchsorted(e, col) for e, col in zip(model.edges, x.T)]
    coarse = [np.searchsorted(e, col) for e, col in zip(model.pair_edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)
    for _ in range(c.rounds):
        for k, cell in enumerate(cells):
            g, h = _sums(cell, len(model.tables[k]), y, 1 / (1 + np.exp(-total)))
            step = c.rate * _tree(g, h, 2)
            model.tables[k] += step
            total += step[cell]
    wide = [len(e) + 1 for e in model.pair_edges]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[i] * wide[j] + coarse[j]
        g, h = _sums(cell, wide[i] * wide[j], y, 1 / (1 + np.exp(-total)))
        return cell, g.reshape(wide[i], wide[j]), h.reshape(wide[i], wide[j])

    gains = sorted(((_grid(*grid(i, j)[1:])[0], i, j) for i in range(len(wide)) for j in range(i)), reverse=True)[: c.pairs]
    tables = {(i, j): np.zeros((wide[i], wide[j])) for _, i, j in gains}
    for _ in range(c.pair_rounds):
        for (i, j), table in tables.items():
            cell, g, h = grid(i, j)
            step = c.rate * _grid(g, h)[1]
            table += step
            total += step.ravel()[cell]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


_KIND = np.zeros((8, 256), bool)
_KIND[0, 65:91] = True
_KIND[1, [35, 36, 37, 38, 42, 94, 95, 123, 125, 126, 60, 62, 61, 92]] = True
_KIND[2, 33] = True
_KIND[3, 124] = True
_KIND[4, 48:58] = True
_KIND[5, [44, 46, 59, 58]] = True
_KIND[6, 128:] = True
_KIND[7, 97:123] = True


def text_features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    binary = column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = binary.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray, at: np.ndarray, by: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[at[1:]] - total[at[:-1]]) / by

    w = words_of(column)
    n = np.diff(w.bounds)
    some = np.maximum(n, 1)
    length = w.end - w.start
    last = w.raw[w.end - 1]
    odd_end = ~(((last >= 97) & (last < 123)) | (last >= 128) | np.isin(last, [44, 46]))
    lines = share(raw == 10, offsets, 1) + 1
    repeated = np.zeros((2, len(n)))
    for d, (a, b) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())):
        if b - a > 1:
            repeated[1, d] = 1 - len(np.unique(w.hash[a:b])) / (b - a)
        if b - a > 3:
            repeated[0, d] = 1 - len(np.unique(grams(w.hash[a:b], 3))) / (b - a - 2)
    kind = [share(k[raw], offsets, size) for k in _KIND]
    return np.stack([
        np.log1p(n), share(length, w.bounds, some), *kind[:7], n / lines, share(length <= 3, w.bounds, some), share(length > 12, w.bounds, some),
        share(odd_end, w.bounds, some), repeated[0], repeated[1], share(_KIND[7][LOWER[raw]], offsets, size),
    ], axis=1)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` for each row."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            x = text_features(block.column(1))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))], ["doc_id", "x"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, x array<double>")


def _given(labels: DataFrame, label_col: str) -> DataFrame:
    return labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg(label_col).alias("y"))


def sampled(ids: DataFrame, labels: DataFrame, label_col: str, config: GamConfig) -> Column:
    """A condition on ``doc_id`` that about twice the sample's labelled ids meet, so few rows travel whatever the input."""
    n = _given(labels, label_col).join(ids, "doc_id", "left_semi").count()
    if n <= 2 * config.sample:
        return F.lit(True)
    return F.xxhash64("doc_id") < F.lit(-(1 << 63) + (1 << 65) * config.sample // n)


def learn(found: DataFrame, labels: DataFrame, label_col: str = "quality", config: GamConfig = GamConfig()) -> Gam:
    """Fit on ``found`` (``doc_id, x``, cut by ``sampled``) joined with labels, at most ``config.sample`` ids."""
    one = found.join(_given(labels, label_col), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, (np.array([r["y"] for r in rows]) >= 0.5).astype(float), config)


def score(found: DataFrame, model: Gam) -> DataFrame:
    """``doc_id, score`` from ``doc_id, x``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, score double")


def classify(docs: DataFrame, labels: DataFrame, config: GamConfig = GamConfig(), train=None) -> DataFrame:
    """``doc_id, score`` for each row of ``docs``; labels only of rows where ``train`` holds."""
    ws = Workspace(docs.sparkSession, "quality")
    found = ws.save(features(docs))
    known = found if train is None else found.where(train)
    return score(found, learn(known.where(sampled(known.select("doc_id"), labels, "quality", config)), labels, config=config))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, config: GamConfig = GamConfig()) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns and no shuffle of texts."""
    model = learn(features(docs.where(sampled(docs.select("doc_id"), labels, "quality", config))), labels, config=config)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            yield block.filter(pa.array(model.score(text_features(block.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
