import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions.similarity import Matcher, label_similarity
from ledgerloom.operators import geometry as G
from ledgerloom.operators.mapping import normalized
from ledgerloom.plans import pipelines as P


def page(spark, boxes, width=900.0, doc="d"):
    rows = [(doc, 0, i, t, float(x0), float(y0), float(x1), float(y1), 1.0, None if width is None else float(width)) for i, (t, x0, y0, x1, y1) in enumerate(boxes)]
    return spark.createDataFrame(rows, G.BOXES)


def table(cells):
    got = {}
    for r in cells.collect():
        got.setdefault(r.row_idx, {})[r.col_idx] = r.cell
    return [[row[c] for c in sorted(row)] for _, row in sorted(got.items())]


def lines(rows):
    got = {}
    for r in rows.orderBy("line", (F.col("x0") + F.col("x1")) / 2).collect():
        got.setdefault(r.line, []).append(r.text)
    return [got[k] for k in sorted(got)]


INVOICE = [
    ("Dt", 10, 10, 60, 30), ("Hotel", 200, 10, 320, 30), ("Ad.", 450, 10, 500, 30), ("ch", 550, 10, 590, 30), ("Cost", 700, 10, 760, 30),
    ("1-Sep", 10, 40, 90, 60), ("Hurghada", 200, 40, 360, 60), ("2", 460, 40, 480, 60), ("1", 555, 40, 575, 60), ("100", 720, 40, 760, 60),
    ("2-Sep", 10, 70, 90, 90), ("Cairo", 200, 70, 320, 90), ("1", 460, 70, 480, 90), ("0", 555, 70, 575, 90), ("500", 720, 70, 760, 90),
    ("Total", 10, 100, 80, 120), ("600", 720, 100, 760, 120),
]


def test_invoice_page(spark):
    boxes = page(spark, INVOICE)
    assert G.column_bands(boxes).count() == 5
    got = table(G.boxes_to_cells(boxes))
    assert len(got) == 4 and got[0] == ["Dt", "Hotel", "Ad.", "ch", "Cost"] and got[3] == ["Total", "", "", "", "600"]
    rows = P.boxes_to_transactions(boxes, 2026)[0].orderBy("row_idx").collect()
    assert [(r.Date, r.Hotel, r.Adult, r.Total) for r in rows] == [("2026-09-01", "Hurghada", 2, 100.0), ("2026-09-02", "Cairo", 1, 500.0)]


ROWS = [
    ([(f"r{i}", 10, 23 * i, 60, 23 * i + 40) for i in range(6)], [[f"r{i}"] for i in range(6)]),
    ([("اسم", 100, 40, 300, 70), ("2", 10, 48, 50, 64), ("فندق", 100, 73, 300, 103), ("2400", 10, 81, 60, 97)], [["2", "اسم"], ["2400", "فندق"]]),
    ([("888-", 10, 100, 60, 122), ("681-", 10, 116, 60, 138), ("1,493-", 10, 132, 60, 154), ("0", 10, 148, 60, 170)], [["888-"], ["681-"], ["1,493-"], ["0"]]),
    ([("888-", 10, 100, 60, 114), ("a", 200, 90, 320, 130), ("b", 340, 90, 420, 130), ("c", 440, 90, 560, 130), ("681-", 10, 118, 60, 132), ("d", 200, 108, 320, 148), ("e", 340, 108, 420, 148), ("f", 440, 108, 560, 148)], [["888-", "a", "b", "c"], ["681-", "d", "e", "f"]]),
]


@pytest.mark.parametrize(("boxes", "want"), ROWS)
def test_rows(spark, boxes, want):
    assert lines(G.rows_of(page(spark, boxes))) == want


def test_narrow_gutters_need_the_header(spark):
    boxes = [(f"H{i}", 198 * i, 10, 198 * i + 186, 34) for i in range(7)] + [(str(100 + i), 198 * i + 60, 50, 198 * i + 120, 74) for i in range(7)]
    df = page(spark, boxes, 1386)
    assert G.column_bands(df).count() == 1
    assert table(G.boxes_to_cells(df)) == [[f"H{i}" for i in range(7)], [str(100 + i) for i in range(7)]]


def test_full_width_and_stacked(spark):
    assert [(r.b0, r.b1) for r in G.column_bands(page(spark, [("x", 0, 0, 900, 10)])).collect()] == [(0.0, 900.0)]
    stacked = [("Notes", 20, 40, 120, 62), ("888-", 20, 100, 120, 122), ("681-", 20, 120, 120, 142), ("1,493-", 20, 140, 120, 162), ("0", 20, 160, 120, 182)]
    assert [r[0] for r in table(G.boxes_to_cells(page(spark, stacked, 400)))] == ["Notes", "888-", "681-", "1,493-", "0"]


def test_packed_box_without_template(spark):
    boxes = [("Date", 0, 10, 190, 30), ("Hotel", 200, 10, 390, 30), ("Total", 400, 10, 590, 30), ("1-Sep", 0, 50, 190, 80), ("2-Sep", 0, 90, 190, 120), ("Hilton", 200, 50, 390, 80), ("Cairo", 200, 90, 390, 120), ("888- 681-", 400, 50, 590, 120)]
    assert table(G.boxes_to_cells(page(spark, boxes, 600))) == [["Date", "Hotel", "Total"], ["1-Sep", "Hilton", "888-"], ["2-Sep", "Cairo", "681-"]]


TEMPLATES = [
    ([("A", 0, 10, 140, 30), ("B", 150, 10, 290, 30), ("C", 300, 10, 440, 30), ("D", 450, 10, 590, 30), ("22 33", 150, 50, 440, 70)], ["A", "B", "C", "D"], [["A", "B", "C", "D"], ["", "22", "33", ""]]),
    ([("A", 0, 10, 200, 30), ("B", 300, 10, 500, 30), ("x\ny\nz", 0, 50, 200, 110)], ["A", "B"], [["A", "B"], ["x", ""], ["y", ""], ["z", ""]]),
    ([("Date", 0, 10, 190, 30), ("Hotel", 200, 10, 390, 30), ("Total", 400, 10, 590, 30), ("1-Sep", 0, 50, 190, 90), ("Hilton", 200, 60, 390, 100), ("100", 400, 70, 590, 110), ("2-Sep", 0, 80, 190, 120), ("Cairo", 200, 90, 390, 130), ("200", 400, 100, 590, 140)], ["Date", "Hotel", "Total"], [["Date", "Hotel", "Total"], ["1-Sep", "Hilton", "100"], ["2-Sep", "Cairo", "200"]]),
    ([("Date", 0, 10, 190, 30), ("Hotel", 200, 10, 390, 30), ("Total", 400, 10, 590, 30), ("Net", 600, 10, 790, 30)] + [(f"{i + 1}-Sep", 0, 50 + 40 * i, 190, 80 + 40 * i) for i in range(4)] + [(h, 200, 50 + 40 * i, 390, 80 + 40 * i) for i, h in enumerate(["Hilton", "Cairo", "Rixos", "Savoy"])] + [("888- 681- 1,493- 991-", 400, 50, 590, 200), ("888- 681- 1,493- 991-", 600, 50, 790, 200)], ["Date", "Hotel", "Total", "Net"], [["Date", "Hotel", "Total", "Net"], ["1-Sep", "Hilton", "888-", "888-"], ["2-Sep", "Cairo", "681-", "681-"], ["3-Sep", "Rixos", "1,493-", "1,493-"], ["4-Sep", "Savoy", "991-", "991-"]]),
]


@pytest.mark.parametrize(("boxes", "labels", "want"), TEMPLATES)
def test_templates(spark, boxes, labels, want):
    cells, unplaced = G.template_cells(page(spark, boxes, 600 if len(labels) < 4 or labels[0] == "A" else 800), labels)
    assert table(cells) == want and unplaced.count() == 0


def test_unplaced_pieces_are_told(spark):
    # The fullest column makes the rows, so the far piece must not be in it, nor as many in its column as there are rows.
    boxes = [b for b in TEMPLATES[2][0] if b[0] not in ("100", "200")] + [("far", 400, 400, 590, 420)]
    cells, unplaced = G.template_cells(page(spark, boxes, 600), ["Date", "Hotel", "Total"])
    assert [r.cell for r in unplaced.collect()] == ["far"] and len(table(cells)) == 3


def test_otsu_matches_plain_search(spark):
    def plain(v):
        v = sorted(v)
        best, cut = -1.0, None
        for i in range(1, len(v)):
            a, b = v[:i], v[i:]
            between = len(a) * len(b) / len(v) ** 2 * (sum(a) / len(a) - sum(b) / len(b)) ** 2
            if between > best + 1e-12:
                best, cut = between, (v[i - 1] + v[i]) / 2
        return cut

    data = {"a": [1.0, 2.0, 30.0, 31.0], "b": [5.0], "c": [1.0, 1.0, 1.0, 9.0, 9.5], "d": [3.0, 3.0]}
    df = spark.createDataFrame([(k, x) for k, v in data.items() for x in v], "k string, v double")
    assert {r.k: r.threshold for r in G.otsu(df, ["k"], "v").collect()} == {k: plain(v) for k, v in data.items()}


def test_turning_a_page(spark):
    df = page(spark, [("x", 10, 20, 30, 60)], 100)
    r = G.rotate(df, F.lit(200.0)).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.page_width) == (140.0, 10.0, 180.0, 30.0, 200.0)


def test_rows_take_the_nearest_free_pieces_as_one_by_one():
    rng = random.Random(3)
    for _ in range(400):
        rows = sorted(rng.choice([float(rng.randint(0, 30)), rng.uniform(0, 30)]) for _ in range(rng.randint(1, 12)))
        ys = sorted(float(rng.randint(0, 30)) for _ in range(rng.randint(1, 14)))
        free, want = set(range(len(ys))), [None] * len(ys)
        for i, y in enumerate(rows):
            best = min(free, key=lambda j: (abs(ys[j] - y), j), default=None)
            if best is not None and abs(ys[best] - y) <= 4.0:
                free.remove(best)
                want[best] = i
        assert G.nearest_free(rows, ys, 4.0) == want


def test_pages_are_snapped_without_a_python_call_each(spark):
    rows = [(d, 0, b, f"{b}:{i}", i * 20.0 + b) for d in range(30) for b in range(3) for i in range(6) if b == 0 or i != (d + b) % 7]
    pieces = spark.createDataFrame(rows, "doc_id int, page int, band int, text string, y double")
    heights = pieces.select("doc_id", "page").distinct().withColumn("median", F.lit(10.0))
    found = G.snap_rows(pieces, heights)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.band, r.cell, r.line) for r in found.collect()) == sorted((d, b, t, int(t[2:])) for d, _, b, t, _ in rows)


def test_only_texts_of_unsure_labels_are_scored(spark, monkeypatch):
    names = ["Adult", "Date", "Hotel Name", "Total Net"]
    texts = ["hotel 12", "Hotel", "net", "DATE", "dat", "Totl net", "123", "zzz", "adults", "name of the hotel", "", "a hotel name 5"]
    scored = []
    monkeypatch.setattr(G, "settle", lambda df, name: scored.extend(r[1] for r in df.collect()) or df if name == "texts" else df)
    boxes = spark.createDataFrame([("s", t) for t in texts] + [(None, "Date"), ("other", "Date")], "supplier string, text string")
    got = {(r.supplier, r.text): r.label for r in G.with_labels(boxes, spark.createDataFrame([("s", n) for n in names], "supplier string, label string")).collect()}
    matcher = Matcher([(n, n) for n in sorted(map(normalized, names))], label_similarity)
    for t in texts:
        name, score = matcher.best(normalized(t))
        assert got["s", t] == (name if score >= K.TEMPLATE_LABEL_MATCH else None), t
    assert got[None, "Date"] is None and got["other", "Date"] is None
    assert not {"hotel", "net", "date", "123", "a hotel name 5"} & set(scored)


def test_boxes_are_cut_without_a_group_each(spark):
    """A page's strips come to its boxes in one row; no box is a group of its own, and one that holds line breaks alone is no piece."""
    boxes = page(spark, [("7", 10, 10, 40, 30), ("\n", 10, 40, 40, 60), ("a b", 20, 70, 180, 90)])
    bounds = spark.createDataFrame([("d", 0, 0, 0.0, 100.0, "Adult"), ("d", 0, 1, 100.0, 900.0, "Hotel")], "doc_id string, page int, band int, b0 double, b1 double, label string")
    cut = G.slice_boxes(boxes, bounds)
    assert not re.search(r"Aggregate\(keys?=\[[^\]]*box_id", cut._jdf.queryExecution().executedPlan().toString())
    assert sorted((r.box_id, r.band, r.text, r.y) for r in cut.collect()) == [(0, 0, "7", 20.0), (2, 0, "a", 80.0), (2, 1, "b", 80.0)]
