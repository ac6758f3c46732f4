"""What the way from grids to the standard schema leaves on disk, and how often it moves rows."""

import random
import time

from ledgerloom.operators import mapping, rows, tables
from ledgerloom.plans import queries
from ledgerloom.sources import store

SF = "/root/testdata/sf0.001"
CELLS = "doc_id long, table_id int, row_idx int, col_idx int, cell string"


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_shuffle_files_go_with_the_step(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        names = files.getAllFiles().mkString("\n").split("\n")
        return {n for n in names if "/shuffle_" in n}

    before = shuffles()
    settled = store.settle(spark.range(5000).repartition(3, "id").groupBy((store.F.col("id") % 7).alias("k")).count(), "counted")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert shuffles() - before == set()
    assert spark.conf.get(store.SHUFFLES_GO) == "false"
    assert sorted(r.k for r in settled.collect()) == list(range(7))


def test_grids_take_one_exchange(spark):
    assert exchanges(rows.to_rows(queries._order_grids(spark, SF), together=True)) == 1


def test_headers_take_one_exchange(spark):
    headers = spark.createDataFrame([(1, 0, 0, "Date"), (1, 0, 1, "Date"), (2, 0, 0, "Total USD")], "doc_id long, table_id int, col_idx int, header string")
    assert exchanges(tables.dedupe_headers(headers)) == 1
    mapped = mapping.map_columns(headers)
    assert exchanges(mapped.groupBy(*tables.TABLE).agg(store.F.count("standard_column"))) == 1


def test_rows_of_odd_grids(spark):
    """Missing columns, null cells and rows in any order, whether cells come dealt out or not."""
    rng = random.Random(8)
    given = {(d, t, r): {c: rng.choice(["x", "", None, "y z"]) for c in rng.sample(range(6), rng.randint(1, 6))} for d in range(40) for t in range(2) for r in rng.sample(range(9), 4)}
    cells = [(*k, c, x) for k, v in given.items() for c, x in v.items()]
    rng.shuffle(cells)
    df = spark.createDataFrame(cells, CELLS)
    want = {k: [v.get(c) for c in range(max(v) + 1)] for k, v in given.items()}
    for together in (False, True):
        got = rows.to_rows(df, together=together)
        assert got.columns == ["doc_id", "table_id", "row_idx", "c"]
        found = [((r.doc_id, r.table_id, r.row_idx), r.c) for r in got.collect()]
        assert len(found) == len(want) and dict(found) == want
