"""Hard negatives against all scores worked out one by one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hardneg as H

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor long"


def plain(rows):
    """Rows of (vec_id, vector, label) by the definition, in Python integers."""
    good = []
    for at, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(c is None or not math.isfinite(c) for c in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        good.append((at, i, [math.floor(256 * float(np.float32(c))) for c in v], label))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for _, a, x, label in good:
        if a is None or a % 50:
            continue
        scored = [(sum(p * q for p, q in zip(x, y)), i, other) for _, i, y, other in good if i != a]
        positives = sorted((s[:2] for s in scored if s[2] == label), key=order)[:5]
        negatives = sorted((s[:2] for s in scored if s[2] != label), key=order)
        for score, positive in positives:
            fit = [n for n in negatives if 50 * score <= 100 * n[0] <= 95 * score][:3]
            out += [(a, positive, k, n, score, s) for k, (s, n) in enumerate(fit, 1)]
    return sorted(out, key=str)


def table(seed=0, n=400, width=12, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    return [(int(i), (centres[rng.integers(6)] * spread + rng.standard_normal(width) * 0.4).tolist(), int(rng.integers(10))) for i in range(n)]


def run(spark, rows, **kw):
    rows = [(i, v and [None if c is None else float(c) for c in v], label) for i, v, label in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(map(tuple, H.hard_negatives(df, moved, F.col("vec_id") % 50 == 0, **kw).collect()), key=str)


def test_all_pairs(spark):
    rows = table()
    want = plain(rows)
    assert len(want) > 60 and run(spark, rows) == want


def test_groups_of_anchors_agree(spark):
    rows = table(1)
    assert run(spark, rows, group_bytes=600) == run(spark, rows) == plain(rows)


def test_nulls_ties_repeats_and_lengths(spark):
    rows = table(2, 120, 4)
    rows += [(200, None, 1), (201, [1.0, float("nan"), 0, 0], 1), (202, [1.0, None, 0, 0], 2), (203, [float("inf"), 0, 0, 0], 3), (204, [1.0, 1.0, 1.0, 1.0], None)]
    rows += [(None, rows[5][1], rows[5][2]), (300, [0.0] * 4, 3), (301, [], 3), (350, [0.5], 4), (351, [0.5, 0.5], 5)]
    rows += [(400 + i, rows[50][1], i % 3) for i in range(30)] + [(60, rows[60][1], rows[60][2])] * 2
    width = max(len(r[1] or []) for r in rows)
    full = [(i, None if v is None else v + [0.0] * (width - len(v)), label) for i, v, label in rows]
    assert run(spark, rows) == plain(full)


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(2**24 + i % 5), float(3 * 2**20 - i), -float(i % 7) * 2**20], i % 10) for i in range(110)]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("keep", [0, 1, 2])
def test_hardly_any_rows(spark, keep):
    assert run(spark, table()[:keep]) == []


def test_bounds_hold_and_pairs_are_skipped():
    """No exact score lies outside its bounds, and clustered rows let most pairs go unscored."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 32)) * 4
    x = np.floor(256 * (centres[rng.integers(20, size=3000)] + rng.standard_normal((3000, 32)) * 0.2)).astype(np.int64)
    refs = H.references(x)
    norm, turn = H.angles(x, refs)
    rows = H.Rows(np.arange(3000), rng.integers(0, 3, 3000), x, norm, turn.astype(float))
    lower, upper = H.score_bounds(rows[:200], rows.turn, rows.turn, rows.norm, rows.norm)
    exact = x[:200] @ x.T
    assert (lower <= exact).all() and (exact <= upper).all()
    wide = np.iinfo(np.int64)
    best = H.Best(np.full((200, 1), wide.min), np.full((200, 1), wide.max), 5)
    for at in range(0, 3000, 600):
        scored, pairs = H.look(rows[:200], rows[at : at + 600], best, True)
    assert scored < pairs / 3
