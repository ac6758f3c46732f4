"""Files, dumps, recognizers, rules, exports and streams, through real folders."""

import base64
import csv
import glob
import shutil

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.constants import REPLY_COLUMNS
from ledgerloom.operators import geometry, mapping, report, tables
from ledgerloom.plans import pipelines
from ledgerloom.sources import readers
from ledgerloom.sources.rules import load_rules, rule_tables
from ledgerloom.streaming import replies


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for name in ("a/inv.pdf", "b/inv.pdf", "b/deep er/Pic.JPG", "notes.txt", "c.PNG"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    rows = {r.doc_id: bytes(r.content) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert rows == {n: n.encode() for n in ("a/inv.pdf", "b/inv.pdf", "b/deep er/Pic.JPG", "c.PNG")}
    assert [r.doc_id for r in readers.read_files(spark, f"file://{tmp_path}/a/").collect()] == ["inv.pdf"]
    assert [r.doc_id for r in readers.read_files(spark, str(tmp_path / "a" / "inv.pdf")).collect()] == ["inv.pdf"]


def test_images_as_urls_and_kinds(spark):
    df = spark.createDataFrame([("x.jpg", b"\xff\xd8"), ("y.PNG", b"p"), ("z.pdf", b"")], "name string, content binary")
    got = [r.u for r in df.select(readers.image_url(F.col("content"), F.col("name")).alias("u")).collect()]
    assert got == ["data:image/jpeg;base64," + base64.b64encode(b"\xff\xd8").decode(), "data:image/png;base64," + base64.b64encode(b"p").decode(), "data:application/pdf;base64,"]


def test_box_dumps_come_back(spark, tmp_path):
    """Written and read again; a dump that is read in many splits numbers its boxes in the file's order, none twice."""
    rows = [("d", 0, i, f"t{i} \"q\"", float(i), 1.5, i + 2.0, 3.0, 0.25, None) for i in range(3)]
    readers.write_box_dump(spark.createDataFrame(rows, geometry.BOXES).coalesce(1), str(tmp_path / "out"))
    back = readers.read_box_dump(spark, str(tmp_path / "out")).orderBy("box_id").collect()
    assert [(r.text, r.x0, r.y0, r.x1, r.y1, r.confidence, r.box_id) for r in back] == [(t, x0, y0, x1, y1, c, i) for _, _, i, t, x0, y0, x1, y1, c, _ in rows]
    for folder in ("a", "b"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "page.txt").write_text("# text\tx0\ty0\tx1\ty1\tconfidence\n" + "".join(f"w{i}\t{i}.0\t0.0\t1.0\t2.0\t0.5\n" for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = readers.read_box_dump(spark, str(tmp_path / "in" / "*")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.doc_id for r in found}) == 2 and len({(r.doc_id, r.box_id) for r in found}) == len(found) == 4000
    assert all(r.text == f"w{r.box_id}" for r in found)


def test_recognizer_of_several_boxes(spark):
    files = spark.createDataFrame([("a", b"x y"), ("b", b""), ("c", b"z")], "doc_id string, content binary")
    engine = lambda content: [(w, (10 * i, 0, 10 * i + 5, 8)) for i, w in enumerate(content.decode().split())]
    got = sorted((r.doc_id, r.box_id, r.text, r.x0, r.x1, r.confidence, r.page_width) for r in readers.recognize(files, engine).collect())
    assert got == [("a", 0, "x", 0.0, 5.0, 1.0, None), ("a", 1, "y", 10.0, 15.0, 1.0, None), ("c", 0, "z", 0.0, 5.0, 1.0, None)]


def test_unknown_engine_is_an_error(spark):
    asked = spark.createDataFrame([("magic",), ("auto",), ("text",), (None,)], "engine string")
    got = asked.select(mapping.choose_engine(F.col("engine"), F.lit(True)).alias("e")).select("e.*").collect()
    assert [tuple(r) for r in got] == [(None, "unknown engine: magic"), ("ocr", None), ("text", None), ("ocr", None)]


def test_rules_file(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "rules.yaml").write_text("standard_columns: [Date, Total]\nsuppliers:\n  north:\n    identifiers: [n1, n2]\n    columns_mapping: {Arrival: Date}\n    notes_columns: {Remark: Memo}\n  empty:\n")
    (tmp_path / "rules.yaml").write_text((tmp_path / "rules.yaml").read_text().replace("  empty:\n", "  south: {identifiers: []}\n"))
    t = rule_tables(spark, load_rules(tmp_path / "rules.yaml"))
    assert [tuple(r) for r in t["supplier_identifiers"].collect()] == [("north", 0, "n1"), ("north", 0, "n2")]
    assert [tuple(r) for r in t["supplier_columns"].collect()] == [("north", 0, "Arrival", "Date")]
    assert [tuple(r) for r in t["supplier_notes"].collect()] == [("north", 0, "Remark", "Memo")]


def test_export_has_amounts_and_subtotal(spark, tmp_path):
    df = spark.createDataFrame([("a", 10.0, 2.0, 0.0, 1.0, 5.0), ("b", 1.0, None, 3.0, 0.0, 2.0)], "Hotel string, EGP double, USD double, Euros double, GBP double, Total double")
    report.to_workbook(df, str(tmp_path / "out"), {"USD": 50.0, "Euros": 55.0, "GBP": 65.0})
    rows = list(csv.DictReader(open(glob.glob(f"{tmp_path}/out/part-*.csv")[0])))
    assert [r["Hotel"] for r in rows][-1] == "TOTAL" and len(rows) == 3
    assert [float(r["EGP Converter"]) for r in rows[:2]] == [10 + 2 * 50 + 65, 1 + 3 * 55]
    assert float(rows[2]["EGP"]) == 11 and float(rows[2]["Total"]) == 7


@pytest.mark.parametrize(("names", "want"), [(["A", "A", "A_1", "A_1"], ["A", "A_2", "A_1", "A_1_1"]), (["", None, "Unnamed_1"], ["Unnamed_0", "Unnamed_1", "Unnamed_1_1"]), (["A", "A", "A"], ["A", "A_1", "A_2"]), (["x", "y"], ["x", "y"]), (["A_1", "A", "A_1", "A"], ["A_1", "A", "A_1_1", "A_2"])])
def test_numbered_headers_never_meet(spark, names, want):
    df = spark.createDataFrame([("d", 0, i, n) for i, n in enumerate(names)], "doc_id string, table_id int, col_idx int, header string")
    got = [r.header for r in tables.dedupe_headers(df).orderBy("col_idx").collect()]
    assert got == want and len(set(got)) == len(got)


def test_boxes_of_large_numbers_are_split(spark):
    rows = [("d", 0, 2**31 - 1, "1 2 3", 0.0, 0.0, 9.0, 30.0, 1.0, 100.0), ("d", 0, 2**31 - 2, " ".join(map(str, range(1500))), 0.0, 0.0, 9.0, 30.0, 1.0, 100.0)]
    got = geometry.expand_packed(spark.createDataFrame(rows, geometry.BOXES)).collect()
    assert len(got) == 1503 == len({r.box_id for r in got})


REPLY = '{"rows": [%s], "footer": {"total": "7", "net": "0"}}' % ("{" + ", ".join(f'"{c}": "{7 if c == "Total" else ""}"' for c in REPLY_COLUMNS) + "}")


def test_replies_in_batches_equal_one_batch(spark, tmp_path):
    texts = {"a/1.json": REPLY, "b/1.json": REPLY.replace('"7", "net"', '"9", "net"'), "c.json": "sorry", "d.json": '{"rows": [{"x": "1"}]}', "e.json": '{"other": 1}', "f.json": '"text"', "g.json": REPLY[:-2]}
    for i, (name, text) in enumerate(texts.items()):
        path = tmp_path / ("first" if i % 2 else "second") / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    home = tmp_path / "in"
    shutil.copytree(tmp_path / "first", home)
    stream = lambda: replies.review_stream(replies.read_replies(spark, str(home)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    stream()
    shutil.copytree(tmp_path / "second", home, dirs_exist_ok=True)
    stream()
    got = {r.doc_id: (r.n_rows, r.error, r.review) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, reply string")
    want = {r.doc_id: (r.n_rows, r.error, r.review) for r in pipelines.review_replies(df)[1].collect()}
    assert got == want == {"a/1.json": (1, None, "OK"), "b/1.json": (1, None, "MISMATCH"), "c.json": (0, "not JSON", None), "d.json": (0, "wrong keys in a row", None), "e.json": (0, "no rows", None), "f.json": (0, "not JSON", None), "g.json": (0, "not JSON", None)}
