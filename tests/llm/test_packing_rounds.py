import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import packing as P


@pytest.mark.parametrize("rounds", [0, 1])
def test_no_piece_is_lost_when_rounds_end(spark, rounds):
    rows = [(i, 0, 0, 1 + i * 7 % 60, 0) for i in range(300)]
    found = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long")
    got = P.pack(found, capacity=100, slack=2, items_per_task=40, max_rounds=rounds).collect()
    assert sorted(r.doc_id for r in got) == list(range(300))


def plain_best_fit(sizes, capacity):
    """Largest first, each into the fullest bin that has room."""
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms[rooms.index(min(fit))] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_equals_the_plain_one():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, rng.choice((5, 50, 100))) for _ in range(rng.randint(0, 60))]
        bins = P.best_fit(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert sorted(100 - sum(sizes[i] for i in b) for b in bins) == plain_best_fit(sizes, 100)


def test_equal_rows_are_dealt_evenly(spark, tmp_path):
    """Copies of one row don't meet in one task, so none holds much more than its share."""
    path = str(tmp_path / "found")
    spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32")).repartition(7).write.parquet(path)
    found = spark.read.parquet(path)
    tasks = P.dealt(found.select("*", F.lit(1).alias("used"), F.array("doc_id").alias("members")), 20, 1).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 20 and max(r["count"] for r in tasks) < 1200
    got = P.pack(found, items_per_task=1000)
    assert got.count() == 20_000
    assert got.select("sequence_id").distinct().count() <= 20_000 // 6 + 25


def test_letters_are_encoded_as_the_tokenizer_does():
    """Words of every kind of letter, composed or not, and punctuation behind them, against the tokenizer itself."""
    from tokenizers import Tokenizer

    from ledgerloom.llm.shared import tokenizer_path

    t, rng = Tokenizer.from_file(tokenizer_path()), random.Random(9)
    letters = [chr(c) for c in [*range(65, 0x600), *range(0x1E00, 0x2010)] if unicodedata.category(chr(c))[0] in "LMN"]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) + rng.choice(("", "", ".", "!?", ")'s", "\u2026.", "'s")) for _ in range(4000)] + letters
    ids, counts = P.token_ids(pa.array(words), tokenizer_path())
    ends = np.cumsum(counts)
    for w, b, e, want in zip(words, ends - counts, ends, t.encode_batch(words, add_special_tokens=False), strict=True):
        assert ids[b : e - 1].tolist() == want.ids, w
