"""Fitted models against plain recomputation: lookup tables, cuts, likelihood, rule growing; samples stay bounded."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import gam, neardup, ordinal, rules, shared, simhash, textstats


def test_scores_are_sums_of_looked_up_numbers():
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=400), rng.integers(0, 4, 400), rng.random(400)]
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 1)).astype(float)
    model = gam.fit(x, y)
    assert len(model.pairs) > 0
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.intercept
        for j, table in enumerate(model.tables):
            total += table[sum(c <= row[j] for c in model.cuts[j])]
        for (i, j), table in model.pairs.items():
            total += table[sum(c <= row[i] for c in model.pair_cuts[i]), sum(c <= row[j] for c in model.pair_cuts[j])]
        assert got == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_tree_steps_are_the_best_cuts():
    """Of all single cuts, then of all second cuts, those of the greatest gain; leaves are shrunken Newton steps."""
    rng = random.Random(5)

    def part(g, h):
        return sum(g) ** 2 / (sum(h) + gam.SHRINK)

    def gain(g, h, a, m, b):
        return part(g[a:m], h[a:m]) + part(g[m:b], h[m:b]) - part(g[a:b], h[a:b])

    for _ in range(50):
        g, h = [rng.gauss(0, 1) for _ in range(7)], [rng.random() + 0.1 for _ in range(7)]
        edges = [0, 7]
        for _ in range(2):
            found = [(gain(g, h, a, m, b), m) for a, b in itertools.pairwise(edges) for m in range(a + 1, b)]
            if max(found)[0] > 1e-9:
                edges = sorted({*edges, max(found)[1]})
        want = [sum(g[a:b]) / (sum(h[a:b]) + gam.SHRINK) for a, b in itertools.pairwise(edges) for _ in range(a, b)]
        assert gam._tree(np.array(g), np.array(h)).tolist() == pytest.approx(want)


def test_ordinal_fit_is_a_maximum():
    """Moving any weight or threshold makes the plainly computed penalised likelihood smaller."""
    rng = np.random.default_rng(6)
    n, features = 500, 3
    dense = rng.random((n, features))
    grade = np.clip(np.rint(dense @ np.array([3.0, -2.0, 0.0]) + rng.normal(0, 0.7, n) + 0.6), 0, 2).astype(int)
    row, feature = np.repeat(np.arange(n), features), np.tile(np.arange(features), n)
    weights, cuts = ordinal._fit(row, feature, dense.ravel(), grade, features, 3)

    def value(w, c):
        above = [np.ones(n)] + [1 / (1 + np.exp(-(dense @ w - k))) for k in c] + [np.zeros(n)]
        p = np.array([above[g][i] - above[g + 1][i] for i, g in enumerate(grade)])
        return np.log(p).mean() - ordinal.RIDGE / 2 * (w**2).sum()

    best = value(weights, cuts)
    assert cuts[0] < cuts[1]
    for k in range(features):
        for move in (-0.3, 0.3):
            assert value(weights + move * np.eye(features)[k], cuts) < best
    for k in range(2):
        for move in (-0.2, 0.2):
            assert value(weights, cuts + move * np.eye(2)[k]) < best


def test_rules_grow_by_the_greatest_gain():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 9, (120, 3)).astype(float)
    bad = (x[:, 1] >= 6) & (x[:, 2] <= 4) | (rng.random(120) < 0.05)
    names, best = ["a", "b", "c"], (0.0, None)
    base = math.log2(bad.mean())
    for j in range(3):
        for cut in range(9):
            for above in (True, False):
                m = x[:, j] >= cut if above else x[:, j] <= cut
                p = (m & bad).sum()
                if p and m.sum() < len(m):
                    best = max(best, (p * (math.log2(p / m.sum()) - base), (names[j], above, float(cut))))
    gain, found = rules._best(x, bad, names)
    assert gain == pytest.approx(best[0])
    m = found.mask(x[:, names.index(found.feature)])
    assert (m & bad).sum() * (math.log2((m & bad).sum() / m.sum()) - base) == pytest.approx(best[0])


def test_covering_removes_what_it_explains():
    rng = np.random.default_rng(9)
    x = rng.random((900, 2))
    bad = (x[:, 0] > 0.8) | (x[:, 1] > 0.85)
    learnt = rules.learn(x, bad, ["a", "b"])
    assert len(learnt) >= 2 and len(learnt) <= rules.MAX_RULES
    hit = np.zeros(900, bool)
    for rule in learnt:
        m = np.ones(900, bool)
        for c in rule:
            m &= c.mask(x[:, ["a", "b"].index(c.feature)])
        assert (m & ~hit & bad).sum() >= 0.9 * (m & ~hit).sum() > 0  # each rule is right about what those before left
        hit |= m
    assert (hit == bad).mean() > 0.97


def test_repeated_ids_and_contradicting_labels_stay_bounded(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, f"own {i}") for i in range(8, 40)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (8, 1), (9, None), (None, 1)] + [(i, i % 2) for i in range(10, 40)], "doc_id long, quality int")
    rows = textstats.labelled_sample(docs, labels, "quality", 20, folds=1).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 20 and not {8, 9, None} & {r.doc_id for r in rows}
    assert all(r.text == "text 0" for r in rows if r.doc_id == 7)
    model = gam.train(docs, labels)
    assert gam.keep_good(docs.withColumns({"row": F.lit(1), "score": F.lit("s")}), model).columns == ["doc_id", "text", "row", "score"]


@pytest.mark.parametrize("keep", [simhash.keep_one_of_each, neardup.keep_one_of_each])
def test_texts_under_one_id_are_not_lost(spark, keep):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "y"), (2, a, "z"), (3, "c d e f g h i", None), (3, "c d e f g h i", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __tag string")
    for n in (1, 4):
        kept = keep(df.repartition(n)).collect()
        assert sorted((r.doc_id, r.text[0]) for r in kept) == [(1, "a"), (1, "b"), (3, "c")]
    assert keep(df.limit(0)).collect() == []


def test_tables_between_steps_are_removed(spark):
    df = shared.materialize(spark.range(3), "three")
    assert df.count() == 3
    shared.release(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.collect()
