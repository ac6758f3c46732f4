import hashlib
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import fracsketch as K

TEXTS = {0: "one two three four five six seven " * 40, 3: "", 4: None, 9: "short", 10: "a b c d e f g h i j k l m n o p " * 30, 11: "Ünï 😀 code points " * 25, 500: "one two three four five six seven " * 40, 501: " \n "}


@pytest.mark.parametrize("rows_per_range", [1, 2, 1000])
def test_next_row_wraps(spark, rows_per_range):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    got = {r.doc_id: r.next_doc_id for r in K.with_next(df, "doc_id", ["doc_id"], {}, "text", rows_per_range).collect()}
    ids = sorted(TEXTS, reverse=True)
    assert got == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_next_row_of_odd_tables(spark):
    df = spark.createDataFrame([(5, "x")], "doc_id long, text string")
    assert [r.next_text for r in K.with_next(df, "doc_id", ["text"], {}, "text").collect()] == ["x"]
    assert K.with_next(df.limit(0), "doc_id", ["text"], {}, "text").collect() == []
    df = spark.createDataFrame([(2**63 - 1, "high"), (-(2**63), "low"), (None, "none"), (7, "m"), (7, "m")], "doc_id long, text string")
    got = {(r.text, r.next_text) for r in K.with_next(df, "doc_id", ["text"], {}, "text", 1).collect()}
    # The smallest long and null are one key: a hash of the text decides which comes first.
    assert got in ({("high", "m"), ("low", "none"), ("m", "low"), ("m", "m"), ("none", "high")}, {("high", "m"), ("none", "low"), ("m", "none"), ("m", "m"), ("low", "high")})
    with pytest.raises(ValueError, match="sketch"):
        K.fingerprints(df.withColumn("sketch", F.lit(1)))


def test_outlying_and_equal_ids_are_spread(spark):
    """One id far from all others, ids that a third of all rows share, and null ones: ranges stay small and the order whole."""
    rows = [(i, f"t{i}") for i in range(400)] + [(2**60, "far")] + [(77, f"s{i}") for i in range(300)] + [(None, f"n{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = K.with_next(df, "doc_id", ["doc_id", "text"], {"__where": F.spark_partition_id(), "range": F.col("__range")}, "text", 50).collect()
    assert len(out) == len(rows)
    after = {r.text: r.next_text for r in out}
    walk, at = [], "far"
    for _ in rows:
        walk.append(at)
        at = after[at]
    assert at == "far" and len(set(walk)) == len(rows)  # one ring
    key = {t: i if i is not None else -(2**63) for i, t in rows}
    assert [key[t] for t in walk] == sorted((key[t] for t in walk), reverse=True)
    sizes = {}
    for r in out:
        sizes[r["range"]] = sizes.get(r["range"], 0) + 1
    assert max(sizes.values()) < 150


def brute_sketch(text):
    """Word hashes, then a shingle's words' hashes one after the other, each as the seed of the next; an eighth of the range is kept."""
    words = (text or "").lower().split()
    if not words:
        return ""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    shingles = [h[i : i + 5] for i in range(len(h) - 4)] or [h]
    out = set()
    for s in shingles:
        seed = 42
        for x in s:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", x), seed)
        out.add(seed)
    kept = [x for x in out if x >> 32 < (1 << 32) // K.SCALE] or [min(out)]
    return "".join(f"{x:016x}" for x in sorted(kept, key=lambda x: x - (1 << 64) if x >> 63 else x))


def test_fingerprints_equal_brute_force(spark):
    texts = [*TEXTS.values(), "a b c d", "a b c d e", "A B\x0bC D E F " * 9]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "text string").select(K.as_string(K.sketch(F.col("text"))).alias("f")).collect()]
    assert got == [brute_sketch(t) for t in texts]


def test_query(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r.doc_id: r for r in K.op7_fracsketch(spark, str(tmp_path)).collect()}
    ids = sorted(TEXTS, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, nxt = TEXTS[i] or "", TEXTS[j] or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
    assert rows[0].fingerprint == rows[500].fingerprint != "" and rows[3].fingerprint == rows[501].fingerprint == ""
    assert rows[9].fingerprint and rows[500].near_next == 0


def test_estimates_follow_the_truth_and_merge(spark):
    import random

    rnd = random.Random(7)
    words = [f"w{i}" for i in range(4000)]
    big = [rnd.choice(words) for _ in range(20000)]
    small, other = big[5000:7000], [rnd.choice(words) for _ in range(2000)]
    df = spark.createDataFrame([(" ".join(big), " ".join(small), " ".join(other))], "b string, s string, o string")
    b, s, o = K.sketch(F.col("b")), K.sketch(F.col("s")), K.sketch(F.col("o"))
    joined = K.sketch(F.concat_ws(" ", "s", "o"))
    row = df.select(K.containment(s, b).alias("c"), K.containment(o, b).alias("z"), K.likeness(s, b).alias("j"), K.likeness(K.merge(s, o), joined).alias("m"), F.size(b).alias("n")).first()
    assert row.c == 1 and row.z < 0.05 and abs(row.j - 0.1) < 0.04 and row.m > 0.98
    assert abs(row.n - 20000 / K.SCALE) < 250
