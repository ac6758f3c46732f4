"""Whitening against numpy's eigenvectors; the qd solver against numpy's singular values."""

import math

import numpy as np
import pytest

from ledgerloom.llm import bidiagonal as B
from ledgerloom.llm import whitening as W

RNG = np.random.default_rng(4)
TURN = np.linalg.qr(RNG.standard_normal((12, 12)))[0]
MATRICES = {
    "plain": RNG.standard_normal((90, 30)),
    "falling": RNG.standard_normal((90, 30)) * 10.0 ** -np.arange(30),
    "rising": RNG.standard_normal((90, 20)) * 10.0 ** (np.arange(20) / 4),
    "equal values": np.diag([5.0, 5, 5, 5, 2, 2, 1, 1, 1, 1, 0.5, 0.5]) @ TURN,
    "near values": np.diag([3, 3 * (1 - 1e-9), 3 * (1 - 1e-5), 2, 2, 2, 1, 1, 1, 1, 1, 1.0]) @ TURN,
    "few directions": RNG.standard_normal((50, 3)) @ RNG.standard_normal((3, 20)),
    "nothing": np.zeros((6, 4)),
    "one": RNG.standard_normal((7, 1)),
    "two": RNG.standard_normal((7, 2)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_values_and_vectors(name):
    r = np.linalg.qr(MATRICES[name], mode="r")
    squares, v = B.right_vectors(r, 4)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.abs(squares - want).max() <= 1e-13 * max(want[0], 1e-300)
    gram, k = r.T @ r, v.shape[1]
    assert np.abs(v.T @ v - np.eye(k)).max() < 1e-11
    assert np.abs(gram @ v - v * squares[:k]).max() <= 1e-13 * max(want[0], 1e-300)


def test_small_values_keep_their_digits():
    """A graded bidiagonal matrix whose least values a Gram matrix would lose: compared with exact fractions by bisection."""
    from fractions import Fraction

    a, b = 10.0 ** -np.arange(0, 24, 2), 10.0 ** -np.arange(1, 23, 2) * 0.5
    squares = B.singular_squares(a, b)

    def below(x):
        """How many eigenvalues of B'B lie below x, by Sylvester's law in exact arithmetic."""
        fa, fb = [Fraction(float(v)) for v in a], [Fraction(float(v)) for v in b]
        count, d = 0, None
        for i in range(len(fa)):
            diagonal = fa[i] ** 2 + (fb[i - 1] ** 2 if i else 0) - x
            d = diagonal - ((fa[i - 1] * fb[i - 1]) ** 2 / d if i else 0)
            count += d < 0
        return count

    for i, s in enumerate(squares):
        assert below(Fraction(float(s)) * (1 + Fraction(1, 10**13))) == len(a) - i
        assert below(Fraction(float(s)) * (1 - Fraction(1, 10**13))) == len(a) - i - 1


def vectors(n=300, width=10):
    rng = np.random.default_rng(6)
    return [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, width)) * np.linspace(2, 0.1, width) + 3)]


def plain(rows, k=4):
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(x) for _, x in good), default=0)
    x = [x + [0] * (width - len(x)) for _, x in good]
    fit = np.array(sorted(set(map(tuple, x))))
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(k, int((values > 1e-9 * values[0]).sum()))
    off = n * np.array(x) - sums
    return [i for i, _ in good], n, (off.astype(object) ** 2).sum(axis=1), off / n @ directions[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), k


def check(spark, rows, parts=4):
    rows = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, n string").repartition(parts)
    got = W.whitened(df).toPandas().sort_values(["component", "vec_id", "deviation"])
    ids, n, deviation, white, explained, k = plain(rows)
    assert len(got) == k * len(ids) and set(got["n"]) <= {n}
    order = sorted(range(len(ids)), key=lambda j: (ids[j], deviation[j]))
    for c in range(k):
        part = got[got["component"] == c + 1]
        assert part["vec_id"].tolist() == [ids[j] for j in order]
        assert part["deviation"].tolist() == [deviation[j] for j in order]
        w = part["whitened"].to_numpy()
        want = white[order, c]
        assert np.abs(w - want * np.sign(w @ want)).max() < 1e-8
        assert np.abs(part["explained"] / explained[c] - 1).max() < 1e-9
    assert (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() <= 1


def test_whitened_rows(spark):
    check(spark, vectors())


def test_any_partitioning(spark):
    check(spark, vectors(), 40)
    check(spark, vectors(), 1)


def test_nulls_repeats_and_lengths(spark):
    rows = vectors(60, 5)
    rows += [(90, None), (91, [1.0, None, 0, 0, 0]), (92, [float("nan")] + [0.0] * 4), (93, [float("-inf")] + [1.0] * 4), (94, [2.0]), (95, [])]
    rows += [(100 + i, rows[7][1]) for i in range(200)] + [rows[3], rows[3]]
    check(spark, rows)


def test_fewer_directions_than_components(spark):
    check(spark, [(i, [float(i % 9), float(i % 9) * 2, float(i % 4)]) for i in range(50)])


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert W.whitened(df).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(2**28 * (i % 3)), float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.deviation is None for r in W.whitened(df).collect() if r.vec_id % 3 != 1} == {True}
