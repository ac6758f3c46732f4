import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash as S


def brute_fp(text):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    return sum(1 << b for b in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in sh) > len(sh))


def brute_components(fps):
    parent = {d: d for d in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: top(d) for d in ids}


def texts():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice([2, 8, 60, 400]))) for _ in range(25)]
    out = [None, "", " \n ", "one", "One\x0bTWO", "É è ñ"] + base + base[:8]
    for b in base:
        w = b.split()
        for _ in range(3):
            v = list(w)
            v[rnd.randrange(len(v))] = "edit"
            out.append(" ".join(v).upper())
    return out


def test_native_hash_is_the_same(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    assert h % 2**64 == xxhash.xxh64_intdigest("a b é".encode(), 42)


def test_query_equals_brute_force(spark, tmp_path):
    rows = dict(enumerate(texts()))
    spark.createDataFrame(list(rows.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    fps = {d: brute_fp(t) for d, t in rows.items()}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op2_simhash_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in rows}


def test_dense_postings_lose_no_link(spark):
    """Thousands of fingerprints in one posting: chains over single bits, and pairs at every distance."""
    rnd = random.Random(5)
    fps = {(0xABCD << 48) | x for x in range(600)} | {0, 1, 3, 7, 0xFF, (1 << 63), (1 << 63) | 1} | {rnd.getrandbits(64) for _ in range(200)}
    signed = {f: f if f < 1 << 63 else f - (1 << 64) for f in fps}
    got = {r.node: r.component for r in S.components(S.near_links(spark.createDataFrame([(f,) for f in signed.values()], "fp long"))).collect()}
    want = brute_components({s: f for f, s in signed.items()})
    assert {s: got.get(s, s) for s in signed.values()} == want


def test_tally_counts_every_meeting(spark):
    """Pairs in small postings are counted as often as they share five positional bytes; the filter keeps six meetings."""
    rnd = random.Random(6)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        g = f
        for p in rnd.sample(range(8), rnd.choice((1, 2, 3))):
            g ^= rnd.randint(1, 255) << (8 * p)
        fps.append(g)
    fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps[:30]]
    signed = sorted({f if f < 1 << 63 else f - (1 << 64) for f in fps})
    want = {}
    for i, u in enumerate(signed):
        for v in signed[i + 1 :]:
            shared = sum((u ^ v) >> (8 * p) & 255 == 0 for p in range(8))
            if shared >= 5:
                want[u, v] = math.comb(shared, 5)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    assert {(r.u, r.v): r.met for r in S.tally(df).collect()} == want
    near = {(u, v) for u, v in want if ((u ^ v) % 2**64).bit_count() <= 2}
    assert {(r.u, r.v) for r in S.near_links(df).collect()} == near
    assert min(want[p] for p in near) >= 6 and min(want.values()) == 1


@pytest.mark.parametrize("bits", [1, 2])
def test_neighbours_are_all_pairs_within_the_bits(bits):
    rnd = np.random.default_rng(1)
    f = np.unique(rnd.integers(0, 1 << 16, 700).astype(np.uint64))
    links = {tuple(map(int, e)) for e in zip(*S.neighbours(f, np.zeros(len(f), np.int64), bits), strict=True)}
    want = {(int(a), int(b)) for a in f for b in f if a < b and int(a ^ b).bit_count() <= bits}
    assert links == want and len(S.meetings(f, np.zeros(len(f), np.int64))[0]) == 0


def test_chain_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(0, 90)] + [(200, 150), (5, 5)], "u long, v long")
    got = {r.node: r.component for r in S.components(edges).collect()}
    assert got == dict.fromkeys(range(91), 0) | {200: 150, 150: 150}
    assert S.components(edges.limit(0)).collect() == []


def test_chains_of_any_length_are_joined(spark):
    """Ids in order along a chain, where each hook reaches one node only."""
    edges = spark.range(600).selectExpr("id + 1 AS u", "id AS v")
    assert {(r.node, r.component) for r in S.components(edges).collect()} == {(i, 0) for i in range(601)}


def test_odd_ids_and_keeping_one(spark):
    rows = [(1, "a b c d", "x"), (1, "q r s t u v w", "y"), (None, "a b c d", "z"), (None, None, "n"), (9, "a b c d", "w"), (9, "a b c d", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.component_id) for r in S.near_duplicates(df).collect()}
    assert got == {(1, 1), (None, 1), (9, 1), (None, None)}
    kept = S.keep_one_of_each(df.where("doc_id is null or component_id <> 'y'"))
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, str(r.text)) for r in kept.collect()) == [(0, "None"), (1, "a b c d")]
    assert S.near_duplicates(df.limit(0)).collect() == [] and S.keep_one_of_each(df.limit(0)).collect() == []
