"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees boosted in cycles over the features learn one lookup table a feature (log-odds by bin); then the pairs that
explain most of what is left get small two-way tables the same way. A score is the logistic function of the sum of the
looked-up numbers, so a batch of documents costs a binning and an addition per table, and every table can be read.

Tables are learnt from a bounded sample of labelled training rows (``SAMPLE_ROWS``); scores cover all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import documents, fold, slices, utf8
from ledgerloom.llm.textstats import SHAPE, labelled_sample, shape_stats, with_stats

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 8, 5
CYCLES, PAIR_CYCLES, RATE, SHRINK = 150, 60, 0.1, 1.0


@dataclass
class Gam:
    """Cut points by feature, tables by feature and tables by pair of features."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)
    intercept: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of ``x``; features that aren't numbers fall into the last bin."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i], side="right"), np.searchsorted(self.pair_cuts[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if len(v) else np.empty(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The steps by bin of a tree with up to three leaves: the best cut, then the best cut of either side."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        if hi - lo < 2:
            return 0.0, lo
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        gain = cg[:-1] ** 2 / (ch[:-1] + SHRINK) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + SHRINK) - cg[-1] ** 2 / (ch[-1] + SHRINK)
        k = int(np.argmax(gain))
        return float(gain[k]), lo + k + 1

    edges = [0, len(g)]
    for _ in range(2):
        gain, at = max(cut(a, b) for a, b in zip(edges, edges[1:], strict=False))
        if gain <= 1e-9:
            break
        edges = sorted({*edges, at})
    step = np.zeros(len(g))
    for a, b in zip(edges, edges[1:], strict=False):
        step[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return step


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree that cuts both features once."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, where = 0.0, None
    part = lambda G, H: G**2 / (H + SHRINK)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    up, right, all_g = cg[:-1, -1:], cg[-1:, :-1], cg[-1, -1]
    uh, rh, all_h = ch[:-1, -1:], ch[-1:, :-1], ch[-1, -1]
    gain = part(a, b) + part(up - a, uh - b) + part(right - a, rh - b) + part(all_g - up - right + a, all_h - uh - rh + b) - part(all_g, all_h)
    if gain.size:
        k = np.unravel_index(np.argmax(gain), gain.shape)
        best, where = float(gain[k]), (k[0] + 1, k[1] + 1)
    step = np.zeros(g.shape)
    if where is not None:
        for r in (slice(0, where[0]), slice(where[0], None)):
            for c in (slice(0, where[1]), slice(where[1], None)):
                step[r, c] = _leaf(g[r, c].sum(), h[r, c].sum())
    return best, step


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learns the tables from a sample. Without both labels there is nothing to learn: the constant share of label 1 (0.5 without rows)."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Gam([_cuts(x[:, j], BINS) for j in range(x.shape[1])], [], [_cuts(x[:, j], PAIR_BINS) for j in range(x.shape[1])], {}, float(np.log(share / (1 - share))))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if len(set(y.tolist())) < 2:
        return model
    bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(CYCLES):
        for j, b in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[j])
            step = RATE * _tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            total += step[b]
    wide = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]

    def grid(i: int, j: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1
        return wide[i] * shape[1] + wide[j], shape

    def found(i: int, j: int) -> tuple[float, np.ndarray, np.ndarray]:
        cell, shape = grid(i, j)
        g, h = slopes()
        n = shape[0] * shape[1]
        gain, step = _quadrants(np.bincount(cell, g, n).reshape(shape), np.bincount(cell, h, n).reshape(shape))
        return gain, step, cell

    ranked = sorted(((found(i, j)[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    model.pairs = {(i, j): np.zeros(grid(i, j)[1]) for i, j in chosen}
    for _ in range(PAIR_CYCLES):
        for i, j in chosen:
            _, step, cell = found(i, j)
            model.pairs[i, j] += RATE * step
            total += RATE * step.ravel()[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Gam:
    """Fits the model on at most ``rows`` labelled training documents; their features (not texts) come to the driver."""
    sample = labelled_sample(docs, labels, label, rows)
    stats = with_stats(sample.select(F.struct("doc_id", "y").alias("k"), "text"), key="k", shape=True).select("k.doc_id", "k.y", "features")
    found = stats.toPandas().sort_values(["doc_id"], kind="stable")
    x = np.array(found["features"].tolist(), float).reshape(len(found), len(SHAPE))
    return fit(x, found["y"].to_numpy(float))


def score_documents(df: DataFrame, model: Gam, key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1) of every row; null and empty texts get the score of zero features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([shape_stats(t) for t in part.column("text").to_pylist()], float)
                yield pa.record_batch([part.column(key), pa.array(model.score(x))], [key, "score"])

    return df.select(F.col(key), utf8().alias("text")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, score double")


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model accepts, with their own columns, whatever those are called; repeated rows fare alike, null and empty texts by the score of zero features."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "row.text"):
                texts = part.column("row").field("text").cast(pa.binary()).to_pylist()
                x = np.array([shape_stats(t or b"") for t in texts], float)
                yield part.filter(pa.array(model.score(x) >= least))

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
