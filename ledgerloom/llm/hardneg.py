"""Hard negatives by angular triangle filtering: stored angles to reference directions bound every score, few are worked out.

For a row x and an anchor a, angles to a reference direction r obey |ar - xr| <= ax <= min(ar + xr, 2 pi - ar - xr). The
tightest interval over all references, widened for rounding, gives an interval of the cosine and, times both norms and
rounded outwards, of the integer score. A pair whose interval misses the window that is asked for (or lies below what has
been found already) is never scored. Rows are stored in cells of one label and nearest reference, whose common interval is
looked at first. What remains is scored in exact integers.

Anchors are the stated query set: they pass by all rows in groups of ``GROUP_BYTES``, each sent to executors once, so no
row moves; every task hands on the best few of each anchor, which a window reduces. References are picked from a bounded
sample, which changes how much is skipped, never a result.

Rows with a null label or vector, or with a null, NaN or infinite component take no part. Shorter vectors count as filled
up with zeros. Repeated rows are rows of their own; rows that bear an anchor's id are none of its others. A row without an
id is never an anchor and comes after all others in a tie. Scores must fit 64 bits (an error otherwise).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import materialize, parts_for

UNIT = 256
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's score may have.
LOW, HIGH = 50, 95
REFERENCES, SAMPLE = 16, 4096
#: Rows of a cell, anchors compared with a cell at once, candidates kept before only the best are.
CELL, CHUNK, LOOSE = 256, 1024, 500_000
GROUP_BYTES = 16 << 20
#: Stored angles are single precision (errors under 2.5e-7); bounds are widened by more.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
_NO_ID = np.iinfo(np.int64).max
_EXACT = 1 << 53


def quantised(table: DataFrame, label: Column, vector: str = "embedding", unit: int = UNIT) -> DataFrame:
    """(vec_id, label, x): floor(unit * component) of the rows that take part."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * unit).cast("bigint"))
    return table.where(F.col(vector).isNotNull() & finite & label.isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), x.alias("x"))


def padded(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("x"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zeros stay) and norms; scaled first, so that nothing overflows."""
    x = x.astype(np.float64)
    top = np.abs(x).max(axis=1, initial=0.0)
    scaled = x / np.where(top > 0, top, 1.0)[:, None]
    length = np.sqrt((scaled**2).sum(axis=1))
    return scaled / np.where(top > 0, length, 1.0)[:, None], top * length


def references(x: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """``n`` unit vectors among the rows of ``x`` that lie far apart: each next one is the farthest from those before."""
    units, norms = _unit(x)
    units = units[norms > 0]
    if not len(units):
        return np.zeros((0, x.shape[1]))
    picked = [0]
    near = units @ units[0]
    while len(picked) < min(n, len(units)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, units @ units[picked[-1]])
    return units[picked]


def angles(x: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to each reference); a zero vector, whose scores are all zero, gets right angles."""
    units, norms = _unit(x)
    return norms, np.arccos(np.clip(units @ refs.T, -1, 1)).astype(np.float32)


@dataclass
class Rows:
    """Some rows of the index as arrays; ``ids`` of rows without one are the largest number."""

    ids: np.ndarray
    label: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    turn: np.ndarray
    top: int = field(init=False)

    def __post_init__(self) -> None:
        self.top = max(abs(int(self.x.max(initial=0))), abs(int(self.x.min(initial=0))))

    @staticmethod
    def of(batch: pa.RecordBatch | pa.Table, width: int, n_refs: int) -> Rows:
        get = lambda c: (batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c))
        ids = get("vec_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        return Rows(ids, get("label").to_numpy(zero_copy_only=False), _matrix(get("x"), width), get("norm").to_numpy(zero_copy_only=False), _matrix(get("turn"), n_refs).astype(np.float64))

    def __getitem__(self, at: slice | np.ndarray) -> Rows:
        return Rows(self.ids[at], self.label[at], self.x[at], self.norm[at], self.turn[at])


def score_bounds(a: Rows, low: np.ndarray, high: np.ndarray, lightest: np.ndarray, heaviest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds (anchors x rows) of the scores with rows whose angles lie in [low, high] and whose norms in [lightest, heaviest]; for cells and single rows."""
    near, least, most = np.zeros((len(a.norm), len(low))), np.full((len(a.norm), len(low)), np.inf), np.zeros((len(a.norm), len(low)))
    for r in range(a.turn.shape[1]):
        mine, lo, hi = a.turn[:, r, None], low[None, :, r], high[None, :, r]
        np.maximum(near, np.maximum(lo - mine, mine - hi), out=near)
        np.minimum(least, mine + hi, out=least)
        np.maximum(most, mine + lo, out=most)
    closest = np.cos(np.maximum(near - ANGLE_SLACK, 0))
    farthest = np.cos(np.minimum(np.minimum(least, 2 * np.pi - most) + ANGLE_SLACK, np.pi))
    upper = a.norm[:, None] * np.where(closest >= 0, heaviest, lightest) * closest
    lower = a.norm[:, None] * np.where(farthest >= 0, lightest, heaviest) * farthest
    slack = SCORE_SLACK * a.norm[:, None] * heaviest
    return np.floor(lower - slack), np.ceil(upper + slack)


def scores(a: Rows, rows: Rows, wanted: np.ndarray) -> np.ndarray:
    """Exact integer scores of the ``wanted`` pairs (a mask, anchors x rows), in the mask's order."""
    i, j = np.nonzero(wanted)
    if a.top * rows.top * a.x.shape[1] >= _EXACT:
        return np.array([int(np.dot(a.x[p].astype(object), rows.x[q].astype(object))) for p, q in zip(i, j, strict=True)], np.int64)
    # Products and sums below 2 ** 53 are exact in doubles.
    some_a, some_r = wanted.any(axis=1), wanted.any(axis=0)
    if len(i) * 4 > some_a.sum() * some_r.sum():
        dense = a.x[some_a].astype(np.float64) @ rows.x[some_r].astype(np.float64).T
        return dense[wanted[np.ix_(some_a, some_r)]].astype(np.int64)
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = np.einsum("ij,ij->i", a.x[p].astype(np.float64), rows.x[q].astype(np.float64))
    return out


class Best:
    """The ``k`` best rows of each of an anchor's windows so far; scores below ``floor`` can't join them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.k, self.high, self.floor = k, high, low.copy()
        self.found = np.empty((0, 3), np.int64)  # window (anchor * windows + its number), score, id
        self.loose: list[np.ndarray] = []
        self.size = 0

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.loose.append(np.stack([window, score, ids], axis=1))
        self.size += len(window)
        if self.size > LOOSE:
            self.prune()

    def prune(self) -> None:
        every = np.concatenate([self.found, *self.loose])
        every = every[np.lexsort((every[:, 2], -every[:, 1], every[:, 0]))]
        start = np.flatnonzero(np.diff(every[:, 0], prepend=-1))
        nth = np.arange(len(every)) - np.repeat(start, np.diff(np.r_[start, len(every)]))
        self.found, self.loose, self.size = every[nth < self.k], [], 0
        full = every[nth == self.k - 1]
        flat = self.floor.reshape(-1)
        flat[full[:, 0]] = np.maximum(flat[full[:, 0]], full[:, 1])


def look(anchors: Rows, rows: Rows, best: Best, same: bool) -> tuple[int, int]:
    """Adds to ``best`` what ``rows`` hold for ``anchors``, of the same label or of others; (pairs whose windows overlap, all pairs)."""
    windows, scored = best.high.shape[1], 0
    starts = np.arange(0, len(rows.ids), CELL)
    cut = np.minimum(starts + CELL, len(rows.ids))
    reduce = lambda f, v: f.reduceat(v, starts, axis=0)
    ends = [reduce(np.minimum, rows.turn), reduce(np.maximum, rows.turn), reduce(np.minimum, rows.norm), reduce(np.maximum, rows.norm)]
    label_low, label_high = reduce(np.minimum, rows.label), reduce(np.maximum, rows.label)
    for first in range(0, len(anchors.ids), CHUNK):
        part = slice(first, first + CHUNK)
        a = anchors[part]
        lower, upper = score_bounds(a, *ends)
        for c, (start, stop) in enumerate(zip(starts, cut, strict=True)):
            mixed = label_low[c] != label_high[c]
            may = (mixed | (a.label == label_low[c])) if same else (mixed | (a.label != label_low[c]))
            overlap = ((upper[:, c, None] >= best.floor[part]) & (lower[:, c, None] <= best.high[part])).any(axis=1)
            who = np.flatnonzero(may & overlap)
            if not len(who):
                continue
            cell, mine = rows[start:stop], a[who]
            lo, up = score_bounds(mine, cell.turn, cell.turn, cell.norm, cell.norm)
            floor, high = best.floor[part][who], best.high[part][who]
            wanted = np.zeros(lo.shape, bool)
            for w in range(windows):
                wanted |= (up >= floor[:, w, None]) & (lo <= high[:, w, None])
            wanted &= (mine.label[:, None] == cell.label) == same
            wanted &= mine.ids[:, None] != cell.ids
            scored += int(wanted.sum())
            i, j = np.nonzero(wanted)
            s = scores(mine, cell, wanted)
            for w in range(windows):
                fit = (s >= floor[i, w]) & (s <= high[i, w])
                if fit.any():
                    best.add((first + who[i[fit]]) * windows + w, s[fit], cell.ids[j[fit]])
    best.prune()
    return scored, len(anchors.ids) * len(rows.ids)


def build_index(rows: DataFrame, width: int, refs: np.ndarray) -> DataFrame:
    """(vec_id, label, x, norm, turn) written once: rows with their norms and angles to ``refs``, dealt into cells batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm, turn = angles(_matrix(batch.column("x"), width), refs)
            near = turn.argmin(axis=1) if len(refs) else np.zeros(len(turn), int)
            least = turn.min(axis=1, initial=np.inf)
            order = pa.array(np.lexsort((least, near, batch.column("label").to_numpy(zero_copy_only=False))))
            flat = pa.ListArray.from_arrays(np.arange(len(turn) + 1, dtype=np.int32) * len(refs), pa.array(turn.reshape(-1)))
            full = pa.record_batch([batch.column("vec_id"), batch.column("label"), batch.column("x"), pa.array(norm), flat], ["vec_id", "label", "x", "norm", "turn"])
            yield full.take(order)

    return materialize(rows.mapInArrow(run, "vec_id long, label long, x array<long>, norm double, turn array<float>"), "index")


def _search(index: DataFrame, anchors: Rows, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor, w, score, id, nth): the ``k`` best rows for each window of each anchor, by score, then id."""
    width, n_refs, windows = anchors.x.shape[1], anchors.turn.shape[1], low.shape[1]
    shipped = index.sparkSession.sparkContext.broadcast((anchors, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, lo, hi = shipped.value
        best = Best(lo, hi, k)
        for batch in batches:
            if batch.num_rows:
                look(mine, Rows.of(batch, width, n_refs), best, same)
        anchor, w = np.divmod(best.found[:, 0], windows)
        ids = best.found[:, 2]
        yield pa.record_batch([pa.array(anchor), pa.array(w), pa.array(best.found[:, 1]), pa.array(ids, mask=ids == _NO_ID)], ["anchor", "w", "score", "id"])

    found = index.mapInArrow(run, "anchor long, w long, score long, id long")
    nth = F.row_number().over(W.partitionBy("anchor", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def _mine(index: DataFrame, anchors: pa.Table, width: int, n_refs: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The hard negatives of one group of anchors. Its positives, a few an anchor, come to the driver as windows of scores."""
    mine = Rows.of(anchors, width, n_refs)
    open_end = np.iinfo(np.int64)
    top = _search(index, mine, np.full((len(mine.ids), 1), open_end.min), np.full((len(mine.ids), 1), open_end.max), positives, True).toArrow()
    at, nth = top["anchor"].to_numpy(), top["nth"].to_numpy() - 1
    ids, score = np.full((len(mine.ids), positives), _NO_ID), np.full((len(mine.ids), positives), -1)
    ids[at, nth], score[at, nth] = top["id"].combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False), top["score"].to_numpy()
    # No score lies between a negative positive's bounds.
    hundreds, rest = np.divmod(score, 100)
    least, most = hundreds * low - (-rest * low) // 100, hundreds * high + rest * high // 100
    least, most = np.where(score < 0, 1, least), np.where(score < 0, 0, most)
    found = _search(index, mine, least, most, negatives, False)
    shipped = index.sparkSession.sparkContext.broadcast((mine.ids, ids, score))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_ids, positive_ids, positive_scores = shipped.value
        for batch in batches:
            a, w = batch.column("anchor").to_numpy(), batch.column("w").to_numpy()
            p = positive_ids[a, w]
            columns = [pa.array(anchor_ids[a]), pa.array(p, mask=p == _NO_ID), batch.column("nth"), batch.column("id"), pa.array(positive_scores[a, w]), batch.column("score")]
            yield pa.record_batch(columns, ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return found.mapInArrow(name, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def hard_negatives(table: DataFrame, label: Column, is_anchor: Column, vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``table`` (vec_id, a vector, what ``label`` needs).

    Each anchor's positives are its ``positives`` best rows of the same label; each positive's negatives are the best rows
    of other labels that score from ``low`` to ``high`` percent of it. An anchor without such rows has none.
    """
    rows = quantised(table, label, vector)
    width, narrow = rows.agg(F.max(F.size("x")), F.min(F.size("x"))).first()
    width = width or 0
    rows = rows if narrow == width else padded(rows, width)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").toArrow()
    refs = references(_matrix(sample["x"].combine_chunks(), width)) if sample.num_rows else np.zeros((0, width))
    index = build_index(rows, width, refs)
    anchors = materialize(index.where(is_anchor).withColumn("__at", F.monotonically_increasing_id()), "anchors")
    groups = parts_for(anchors.count() * (8 * (width + len(refs) + 4 + 3 * positives)), group_bytes)
    parts = []
    for g in range(groups):
        held = anchors.where(F.pmod(F.xxhash64("__at"), F.lit(groups)) == g).drop("__at").toArrow()
        part = _mine(index, held, width, len(refs), positives, negatives, low, high)
        parts.append(materialize(part, "negatives") if groups > 1 else part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return found


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``: every fiftieth vec_id is an anchor, every seventh has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), moved, F.col("vec_id") % 50 == 0)
