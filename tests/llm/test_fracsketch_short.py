import random

from pyspark.sql import functions as F

from ledgerloom.llm import fracsketch as K


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_short_documents_are_compared_exactly(spark, tmp_path):
    rnd = random.Random(1)
    texts = {i: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(6 + i % 30)) for i in range(60)}
    texts |= {i + 1000: " ".join([texts[i], "and more words"]) for i in range(10)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    ids = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in K.op7_fracsketch(spark, str(tmp_path)).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        t, nxt = texts[i], texts[j]
        a, b, c = shingles(t), shingles(t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]), shingles(nxt)
        assert abs(rows[i].near_edited - len(a & b) / len(a | b)) < 1e-12
        assert abs(rows[i].near_next - len(a & c) / len(a | c)) < 1e-12
        assert abs(rows[i].contained_in_edited - len(a & b) / len(a)) < 1e-12


def test_one_hash_above_the_threshold_is_not_a_zero(spark):
    rnd = random.Random(2)
    rows = [(s := " ".join(f"w{rnd.randrange(10**6)}" for _ in range(6)), " ".join([s] + [f"v{rnd.randrange(10**6)}" for _ in range(300)])) for _ in range(40)]
    df = spark.createDataFrame(rows, "s string, b string")
    s, b = K.sketch(F.col("s")), K.sketch(F.col("b"))
    got = df.select(K.containment(s, b).alias("c")).collect()
    assert {r.c for r in got} == {1.0, None}
