import hashlib
import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from ledgerloom.llm import hilbert as H


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (3, 4), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    points = np.array(list(product(range(1 << bits), repeat=dims)))
    at = H.curve_index(list(points.T), bits)
    assert sorted(at) == list(range(len(points)))
    path = points[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def rows_of(n):
    return [(i, f"s{i % 7}" if i % 3 else "hot", ["en", "fr", None][i % 3], "x" * (i * i % 997)) for i in range(n)]


def brute(rows, shards):
    """Shards from a plain sort by (curve place, salt, id)."""

    def bins(values):
        count, before, out = Counter(values), 0, {}
        for v in sorted(count, key=lambda v: (v is not None, v)):
            out[v] = before * 16 // len(values)
            before += count[v]
        return out

    def klass(size):
        w = size.bit_length()
        return w * 8 + ((size << 3) >> (w - 1)) - 8

    cols = [[r[1] for r in rows], [r[2] for r in rows], [klass(len(r[3].encode()) + 1) for r in rows]]
    code = [bins(c) for c in cols]
    at = H.curve_index([np.array([code[k][v] for v in cols[k]]) for k in range(3)], 4)
    crc = [zlib.crc32(r[3].encode()) for r in rows]
    salt = [int(hashlib.md5(f"{r[0]}:{c}".encode()).hexdigest()[:8], 16) % H.MIN_SALTS for r, c in zip(rows, crc, strict=True)]
    order = sorted(range(len(rows)), key=lambda i: (at[i], salt[i], rows[i][0], crc[i]))
    out = {}
    for rank, i in enumerate(order):
        s = rank * shards // len(rows)
        out[rows[i][0]] = (s, rank - math.ceil(s * len(rows) / shards))
    return out


@pytest.mark.parametrize("n", [1, 5, 523])
def test_query_equals_brute_force(spark, tmp_path, n):
    rows = rows_of(n)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, g, s, len(t)) for i, s, g, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    got = H.op1_hilbert_shards(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == brute(rows, H.SHARDS)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min([counts.get(s, 0) for s in range(H.SHARDS)]) <= 1
    for r in got:
        t = rows[r.doc_id][3].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)


def test_nulls_repeats_and_empty(spark, tmp_path):
    path = str(tmp_path / "documents.parquet")
    rows = [(None, None, None, None), (1, "a", "en", "s"), (1, "a", "en", "s"), (2, "", None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df.write.parquet(path)
    got = H.op1_hilbert_shards(spark, str(tmp_path)).collect()
    assert len(got) == 4 and sorted(r.size for r in got) == [1, 1, 2, 2]
    assert len({(r.shard, r.slot) for r in got}) == 4
    assert H.hilbert_shards(df.limit(0), ["lang", "source"]).collect() == []
    with pytest.raises(ValueError, match="already there"):
        H.hilbert_shards(df.withColumnRenamed("lang", "shard"), ["source"])


def test_shards_are_written_in_curve_order(spark, tmp_path):
    df = spark.createDataFrame(rows_of(60), "doc_id long, source string, lang string, text string")
    H.write_shards(H.hilbert_shards(df, ["source", "lang"]), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60 and set(df.columns) <= set(back.columns)


def test_many_values_and_hot_residues(spark):
    """A dimension of more values than a task takes gives the same shards; ids of one residue and null ids spread over salts."""
    rows = [(64 * i if i % 3 else None, f"v{i * 7919 % 1000}", i) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, a string, n int")
    want = {r.n: (r.shard, r.slot) for r in H.hilbert_shards(df, ["a", "n"], tie="n").collect()}
    got = {r.n: (r.shard, r.slot) for r in H.hilbert_shards(df, ["a", "n"], tie="n", values_per_task=90).collect()}
    assert got == want and len(set(want.values())) == len(rows)
