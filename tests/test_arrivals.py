"""Rows and footers that arrive in any order, late and twice, give what a batch of all of them gives; state stays bounded."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import arrivals as A

ROWS = "doc_id string, row_idx int, total string, net string, at timestamp"
FOOTERS = "doc_id string, footer_total string, footer_net string, at timestamp"
T0 = dt.datetime(2025, 1, 1)


def batch():
    """Documents a few hours apart; one without a footer, one whose footer is off, one sent in two runs, null amounts, some rows and footers twice."""
    when = lambda d, m: T0 + dt.timedelta(hours=5 * d, minutes=m)
    rows = [(f"d{d}", i, str(10 * d + i), None if d == 4 else "1", when(d, 3 * i)) for d in range(16) for i in range(4)]
    rows += [("d2", 9, "5", "1", when(2, 150))] + rows[3:9]
    footers = [(f"d{d}", None if d == 6 else str(sum(10 * d + i for i in range(4)) + (d == 5)), "0" if d == 4 else "4", when(d, 40 * (d % 2) - 10)) for d in range(16) if d != 7]
    return rows, footers + footers[2:4]


def arrive(spark, folder, rows, schema, seed):
    """Each of ten hours' rows in files, those of two neighbouring stretches mixed; then what moves the time on to the end."""
    rnd = random.Random(seed)
    by = {}
    for r in rows:
        by.setdefault(int((r[-1] - T0).total_seconds() // 36000) + rnd.choice((0, 1)), []).append(r)
    parts = [by[k] for k in sorted(by)]
    for k, part in enumerate(parts):
        rnd.shuffle(part)
    parts += [[("~", 0, "0", "0", T0 + dt.timedelta(days=9 + k)) if schema == ROWS else ("~", "0", "0", T0 + dt.timedelta(days=9 + k))] for k in range(2)]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/t{k:03d}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_is_the_batch(spark, tmp_path, seed):
    rows, footers = batch()
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = A.reviewed(arrive(spark, tmp_path / "r", rows, ROWS, seed), arrive(spark, tmp_path / "f", footers, FOOTERS, seed + 10), delay="25 hours")
        query = A.start(stream, str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = spark.read.parquet(str(tmp_path / "out")).where("doc_id <> '~'").collect()
    want = A.reviewed(spark.createDataFrame(rows, ROWS), spark.createDataFrame(footers, FOOTERS)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 17
    found = {(r.doc_id, r.n_rows): r.matches for r in want}
    assert found["d5", 4] is False and found["d7", 4] is None and found["d6", 4] is True and found["d3", 4] is True
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < len(rows) / 2 and max(held) < 2.5 * len(rows)


def test_sessions_are_islands(spark):
    """Runs over time are the runs that islands of numbers are."""
    from ledgerloom.operators.geometry import islands

    rnd = random.Random(3)
    rows = [(f"k{i % 3}", rnd.randrange(3000)) for i in range(200)]
    df = spark.createDataFrame(sorted(set(rows)), "k string, s int").withColumn("at", F.timestamp_seconds("s"))
    got = A.sessions(df, ["k"], "30 seconds", [F.count(F.lit(1)).alias("n"), F.min("s").alias("low")]).select("k", "low", "n").collect()
    plain = islands(df, ["k"], F.col("s"), F.lit(30), [], "run").groupBy("k", "run").agg(F.min("s").alias("low"), F.count(F.lit(1)).alias("n")).select("k", "low", "n").collect()
    assert sorted(got) == sorted(plain) and len(got) > 20
