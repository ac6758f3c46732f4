"""The data sources: one file an invoice, all or nothing; pages of which pushed filters leave files unopened."""

import csv
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, IsNotNull, StringContains

from ledgerloom.operators import report
from ledgerloom.sources import files, readers


def contents(path):
    out = {}
    for name in sorted(os.listdir(path)):
        with open(path / name, newline="", encoding="utf-8") as f:
            out[name] = list(csv.reader(f))
    return out


def rows(spark, n_docs, per=3):
    every = spark.range(n_docs * per).selectExpr(f"concat('inv/', id div {per}) as doc_id", f"cast(id % {per} as int) as row_idx", "concat('Hotel ', id) as Hotel", "double(id) as EGP")
    return every.withColumns({c: F.lit(0.0) for c in ("USD", "Euros", "GBP")}).repartition(7)


def test_a_thousand_files_in_eight_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        files.export_files(rows(spark, 1000), str(tmp_path), rates={"USD": 1.0, "Euros": 1.0, "GBP": 1.0})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = contents(tmp_path)
    assert len(got) == 1000
    for i in (0, 7, 999):
        lines = got[f"inv%2F{i}.csv"]
        assert lines[0] == ["Hotel", "EGP", "USD", "Euros", "GBP", "EGP Converter"]
        assert [r[0] for r in lines[1:]] == [f"Hotel {3 * i + k}" for k in range(3)] + ["TOTAL"]
        assert [float(r[1]) for r in lines[1:]] == [3 * i, 3 * i + 1, 3 * i + 2, 9 * i + 3]


def test_files_are_replaced_and_others_stay(spark, tmp_path):
    files.export_files(rows(spark, 5), str(tmp_path))
    files.export_files(rows(spark, 2).withColumn("Hotel", F.lit("again")), str(tmp_path))
    got = contents(tmp_path)
    assert len(got) == 5
    assert got["inv%2F1.csv"][1][0] == "again" and got["inv%2F2.csv"][1][0] == "Hotel 6"


def test_failed_job_leaves_nothing(spark, tmp_path):
    """One task fails midway: files of before stay whole, none of the failed job appears, staging is gone."""
    files.export_files(rows(spark, 4), str(tmp_path))
    before = contents(tmp_path)
    broken = rows(spark, 40).withColumn("Hotel", F.when(F.col("doc_id") == "inv/33", F.raise_error(F.lit("broken"))).otherwise(F.lit("new")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        files.export_files(broken, str(tmp_path))
    assert contents(tmp_path) == before


def test_a_retried_task_counts_once(tmp_path):
    """Two attempts of a task stage the same files; what the committed one names is moved, the other's goes."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id string, Hotel string")
    writer = files.InvoiceFilesWriter({"path": str(tmp_path), "by": "doc_id"}, schema, False)
    rows = [{"doc_id": d, "Hotel": h} for d, h in (("a", "1"), ("a", "2"), ("b", "3"))]
    writer.write(iter(rows[:1]))
    writer.commit([writer.write(iter(rows)), None])
    assert contents(tmp_path) == {"a.csv": [["Hotel"], ["1"], ["2"]], "b.csv": [["Hotel"], ["3"]]}
    writer = files.InvoiceFilesWriter({"path": str(tmp_path), "by": "doc_id"}, schema, True)
    with pytest.raises(ValueError, match="several tasks"):
        writer.commit([writer.write(iter(rows[:1])), writer.write(iter(rows[1:]))])
    writer.commit([writer.write(iter(rows[2:]))])
    assert contents(tmp_path) == {"b.csv": [["Hotel"], ["3"]]}


def test_keys_of_all_kinds_have_files_of_their_own(spark, tmp_path):
    keys = ["a", "A/b", "../up", ".hidden", "_staging", "%2Fx", "/x", "~t", "", None, "é", "x.1"]
    names = [files.file_name(k, 0, ".csv") for k in keys] + [files.file_name("x", 1, ".csv")]
    assert len(set(names)) == len(names)
    assert all("/" not in n and not n.startswith(("_", ".")) or n == ".csv" for n in names)


def test_a_large_key_is_cut(spark, tmp_path):
    files.export_files(rows(spark, 1, per=25), str(tmp_path), max_rows=10)
    got = contents(tmp_path)
    assert [len(v) - 1 for _, v in sorted(got.items(), key=lambda kv: kv[0].count("+1") + 2 * kv[0].count("+2"))] == [10, 10, 6]
    assert got["inv%2F0+2.csv"][-1][0] == "TOTAL" and float(got["inv%2F0+2.csv"][-1][1]) == sum(range(25))


def test_nothing_to_write(spark, tmp_path):
    files.export_files(rows(spark, 3).where("false"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or os.listdir(tmp_path / "none") == []


def test_subtotals_by_document(spark):
    df = rows(spark, 3).select("doc_id", "row_idx", "Hotel", "EGP")
    got = report.with_subtotals(df, "doc_id", "row_idx").where("is_total").orderBy("doc_id").collect()
    assert [(r.doc_id, r.row_idx, r.Hotel, r.EGP) for r in got] == [(f"inv/{i}", 2, "TOTAL", 9.0 * i + 3) for i in range(3)]


@pytest.fixture
def pages(tmp_path):
    for doc in ("a", "b"):
        (tmp_path / doc).mkdir()
        for page in range(4):
            (tmp_path / doc / f"page-{page}.tsv").write_text(f"# text\tx0\n{doc}{page}\t1\t2\t3.5\t4\t0.5\n\nodd\t1\tx\n", encoding="utf-8")
    (tmp_path / "lone.TSV").write_text("single\t1\t2\t3\t4\t1\n", encoding="utf-8")
    (tmp_path / "_tmp").mkdir()
    (tmp_path / "_tmp" / "half.tsv").write_text("half")
    return tmp_path


def test_pages_and_their_boxes(spark, pages):
    boxes = files.dumped_boxes(files.page_files(spark, str(pages), ".tsv", task_bytes=40)).collect()
    got = sorted((b.doc_id, b.page, b.box_id, b.text, b.x0, b.y0, b.x1, b.y1, b.confidence) for b in boxes)
    want = [(d, p, 0, f"{d}{p}", 1.0, 2.0, 3.5, 4.0, 0.5) for d in "ab" for p in range(4)] + [(d, p, 1, "odd", 1.0, None, None, None, None) for d in "ab" for p in range(4)] + [("lone.TSV", 0, 0, "single", 1.0, 2.0, 3.0, 4.0, 1.0)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_like_the_csv_reader(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("# c\nA b\t1\t2\t3\t4\t0.5\n\"q\"\t5\t6\t7\t8\t1\n", encoding="utf-8")
    one = readers.read_box_dump(spark, str(tmp_path)).collect()
    two = files.dumped_boxes(files.page_files(spark, str(tmp_path), ".tsv")).select(*one[0].__fields__).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_filters_leave_files_unopened(spark, pages):
    """Pushed filters are gone from the plan, and from the files that tasks are given."""
    df = files.page_files(spark, str(pages), ".tsv").where("doc_id = 'a' and page >= 2")
    assert sorted((r.doc_id, r.page, len(r.content) > 5) for r in df.collect()) == [("a", 2, True), ("a", 3, True)]
    assert "Filter (" not in df._jdf.queryExecution().executedPlan().toString()
    reader = files.PageFilesReader({"path": str(pages), "suffix": ".tsv"}, df.schema)
    other = StringContains(("content",), "x")
    assert list(reader.pushFilters([EqualTo(("doc_id",), "a"), GreaterThanOrEqual(("page",), 2), IsNotNull(("page",)), other])) == [other]
    assert [os.path.relpath(f[0], pages) for p in reader.partitions() for f in p.files] == ["a/page-2.tsv", "a/page-3.tsv"]
    for test, n in (("page in (2, 3)", 4), ("doc_id like 'a%' and page = 3", 1), ("page < 0", 0), ("doc_id = 'a' and page > 2", 1), ("doc_id = 'a' and page <= 3 and page >= 2 and length > 100000", 0)):
        assert files.page_files(spark, str(pages), ".tsv").where(test).count() == n


def test_columns_that_are_not_asked_for_are_not_read(spark, pages):
    df = files.page_files(spark, str(pages), ".tsv", columns=("doc_id", "page"))
    assert df.columns == ["doc_id", "page"] and df.count() == 9


def test_read_tasks_are_bounded(spark, pages):
    assert files.page_files(spark, str(pages), ".tsv", task_bytes=80).rdd.getNumPartitions() >= 4
    assert files.page_files(spark, str(pages), ".tsv").rdd.getNumPartitions() == 1


def test_what_a_task_tells_the_driver_is_small(tmp_path):
    """A few bytes a file, not two paths; all files are named and moved in order, and a task without rows names none."""
    import pickle

    from pyspark.sql import Row

    schema = files.StructType.fromJson({"type": "struct", "fields": [{"name": n, "type": "string", "nullable": True, "metadata": {}} for n in ("doc_id", "v")]})
    writer = files.InvoiceFilesWriter({"path": str(tmp_path), "by": "doc_id"}, schema, False)
    message = writer.write(Row(doc_id=f"{i:05d}\n", v=str(i)) for i in range(2000))
    assert len(pickle.dumps(message)) < 20 * 2000
    nothing = writer.write(iter(()))
    assert list(nothing.files()) == []
    writer.commit([message, nothing])
    got = contents(tmp_path)
    assert len(got) == 2000 and got["00017%0A.csv"] == [["v"], ["17"]]
