"""The sampler against one that seats a customer at a time, exact laws, and scores that no partitioning changes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import pitmanyor as P

NONE = np.empty(0, np.int64)


def bucket(counts):
    """A bucket of cells {(word, context): customers}."""
    cells = sorted(counts.items())
    words = sorted({w for (w, _), _ in cells})
    return P.Bucket(pa.array([str(w).encode() for w in words], pa.binary()), np.array([words.index(w) for (w, _), _ in cells]), np.array([c for (_, c), _ in cells], np.uint8), np.array([n for _, n in cells]), NONE, NONE, NONE, NONE, NONE)


def test_seating_gives_a_distribution():
    rng = random.Random(1)
    b = bucket({(rng.randrange(40), rng.randrange(9)): rng.choice((1, 1, 2, 5, 30, 400)) for _ in range(300)} | {(99, 60): 1})
    seated = P.sample_bucket(b, b.sums(), (4,), 2, 4)
    g = P.seated_sums(b, seated)
    n = len(b.words)
    wider = P.Seated(seated.tables, np.r_[seated.customers, 0], np.r_[seated.parents, 0])  # one word that training never saw
    for context in (0, 3, 8, 50):
        p = P.pair_probabilities(b, wider, g, np.arange(n + 1), np.full(n + 1, context))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()
    assert (seated.tables <= b.cell_count).all() and (seated.tables >= 1).all()


def plain_sampler(counts, d, d0, sweeps, burn_in, rng):
    """Mean tables by cell when every customer leaves and is seated again, one at a time, at both levels."""
    words = len({w for w, _ in counts})
    floor, top, mean = {}, {}, dict.fromkeys(counts, 0.0)

    def base(w):
        n, t = sum(map(sum, top.values())), sum(map(len, top.values()))
        mine = top.get(w, [])
        return (sum(mine) - d0 * len(mine) + (P.THETA + d0 * t) / (words + 1)) / (P.THETA + n)

    def sit(tables, discount, new):
        weights = [max(x - discount, 0.0) for x in tables] + [new]
        at = rng.choices(range(len(weights)), weights)[0]
        if at == len(tables):
            tables.append(0)
        tables[at] += 1
        return at == len(tables) - 1 and tables[at] == 1

    def leave(tables):
        at = rng.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            del tables[at]
            return True
        return False

    def opened(context):
        return sum(len(t) for (_, c), t in floor.items() if c == context)

    def seat(w, c):
        if sit(floor.setdefault((w, c), []), d, (P.THETA + d * opened(c)) * base(w)):
            sit(top.setdefault(w, []), d0, (P.THETA + d0 * sum(map(len, top.values()))) / (words + 1))

    for (w, c), n in counts.items():
        for _ in range(n):
            seat(w, c)
    for sweep in range(sweeps):
        for (w, c), n in counts.items():
            for _ in range(n):
                if leave(floor[w, c]):
                    leave(top[w])
                seat(w, c)
        if sweep >= burn_in:
            for k in counts:
                mean[k] += len(floor[k]) / (sweeps - burn_in)
    return mean


def test_like_seating_one_customer_at_a_time():
    counts = {(0, 0): 40, (0, 1): 25, (0, 2): 3, (1, 0): 12, (2, 1): 9, (3, 0): 2, (3, 2): 2, (4, 2): 1, (5, 1): 1, (6, 0): 1}
    b = bucket(counts)
    s = b.sums()
    want = plain_sampler(counts, s.discount, s.word_discount, 1500, 100, random.Random(5))
    got = P.sample_bucket(b, s, (9,), 100, 4096)
    assert abs(got.tables.sum() - sum(want.values())) < 0.06 * sum(want.values())
    for (k, n), t in zip(sorted(want.items()), got.tables, strict=True):
        assert abs(t - n) < 0.12 * n + 0.15, (k, n, t)


def test_ways_of_seating():
    """Stirling numbers against their definition by adding up all seatings of few customers."""
    d = 0.3

    def ways(c, t):
        if c == 0:
            return float(t == 0)
        return (ways(c - 1, t - 1) if t else 0.0) + (max(c - 1 - d * t, 0.0) * ways(c - 1, t) if 0 < t < c else 0.0)

    table = P.log_stirling(d, 8)
    for c in range(1, 9):
        for t in range(1, c + 1):
            assert np.exp(table[c * (c - 1) // 2 + t - 1]) == pytest.approx(ways(c, t))


@pytest.mark.parametrize("d", [0.3, 0.8])
@pytest.mark.parametrize("a", [0.01, 3.0, 40.0, 900.0])
def test_saddle_point_meets_the_exact_law(d, a):
    c = 700
    t = np.arange(1, c + 1)
    log_w = P.log_stirling(d, c)[c * (c - 1) // 2 :] + t * np.log(a)
    w = np.exp(log_w - log_w.max())
    w /= w.sum()
    mean = (w * t).sum()
    got, var = P.saddle(np.array([float(c)]), np.array([a]), d)
    exact = (w * t * t).sum() - mean**2
    assert 1 + got[0] == pytest.approx(mean, abs=0.1 * exact**0.5 + 0.001)
    assert var[0] == pytest.approx(exact, rel=0.06, abs=0.02)


def test_scores_do_not_follow_partitions(spark):
    """One to seven partitions, blocks of any size, and buckets split into ranges score alike; null and extra columns too."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(300)]
    rows = [(i if i % 17 else None, " ".join(rng.choices(words, k=rng.randint(0, 60))) if i % 13 else None, i % 5 == 1, i) for i in range(200)] + [(900, "long " * 20_000, False, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean, bucket int")

    def scored(n, **how):
        return sorted(map(repr, P.score_documents(docs.repartition(n), bucket_bytes=4096, **how).collect()))

    want = scored(1)
    assert len(want) == 201
    for n, how in ((3, {}), (7, {"block_bytes": 2000}), (5, {"block_bytes": 1000, "range_bytes": 2000})):
        assert scored(n, **how) == want


def test_contexts_are_words(spark):
    """Words with the same ending are different contexts: what follows each is certain."""
    df = spark.createDataFrame([(i, " ".join(["king left sing right"] * 30), i % 5 == 1) for i in range(40)], "doc_id long, text string, held boolean")
    assert all(r.perplexity < 1.2 for r in P.perplexity(P.score_documents(df)).collect())


def test_range_without_training_knows_the_others():
    """A pair that one range met in held-out texts only has the count that the bucket's other ranges give it."""

    def payload(trained):
        return P.pack_arrays(*(np.array(a) for a in ([0], [2], [0, 5], [0, 1], trained)))

    parts = [P.build_bucket(np.array([i]), [payload(n)], some=True) for i, n in enumerate(([0, 0], [3, 1], [2, 0]))]
    whole = P.merge_buckets(parts)
    g = whole.sums()
    seats = P.Seated(np.full((whole.cell_count > 1).sum(), 2.0), np.array([3.0]), np.array([1.0]))
    for p in parts:
        (_, answer), = P.answers(p, seats, g, np.zeros(1), whole)
        assert P.unpack_arrays(answer)[2] == pytest.approx([5 - 2 * g.discount, 1 - g.discount])
