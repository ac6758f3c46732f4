"""Routed batches, layouts by supplier and many identifiers, on small cases worked out by hand or plainly."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import geometry as G
from ledgerloom.operators import matching
from ledgerloom.plans import batch
from ledgerloom.sources import readers
from ledgerloom.sources.rules import Rules

RULES = Rules.of({"standard_columns": ["Date", "Hotel", "Total", "Notes"], "suppliers": {"north": {"identifiers": ["north desk"], "columns_mapping": {"Arrival": "Date", "Resort": "Hotel", "Sum": "Total"}, "notes_columns": {"Memo": "Memo"}}, "bare": {}}})
DOCS = "doc_id string, name string, engine string, supplier string, text string, pages int"
CELLS = "doc_id string, table_id int, row_idx int, col_idx int, cell string"


def plain_suppliers(texts, identifiers):
    out = {}
    for doc, text in texts:
        low, hits = (text or "").lower(), {}
        for supplier, order, mark in identifiers:
            if (mark or "").lower() in low:
                hits[order, supplier] = hits.get((order, supplier), 0) + 1
        if hits:
            out[doc] = min(hits, key=lambda k: (-hits[k], k[0]))[1]
    return out


@pytest.mark.parametrize("characters", [2_000_000, 400])
def test_many_identifiers(spark, characters):
    """Overlapping, contained, repeated, shared and empty identifiers, in one automaton and in several."""
    rnd = random.Random(1)
    marks = [("".join(rnd.choice("abÉc ") for _ in range(rnd.randint(1, 6)))) for _ in range(300)]
    identifiers = [(f"s{i % 40}", i % 40, m.upper() if i % 3 else m) for i, m in enumerate(marks)] + [("s3", 3, marks[0]), ("s3", 3, marks[0]), ("s5", 5, marks[0])]
    texts = [(i, "".join(rnd.choice("aBéc  x") for _ in range(rnd.randint(0, 60)))) for i in range(80)] + [(80, None), (81, ""), (82, "zzz")]
    for more in ([], [("s9", 9, ""), ("s9", 9, None)]):
        df = spark.createDataFrame(identifiers + more, "supplier string, decl_order int, identifier string")
        got = matching.detect_suppliers(spark.createDataFrame(texts, "doc_id long, text string"), df, characters).collect()
        assert {r.doc_id: r.supplier for r in got} == plain_suppliers(texts, identifiers + more)


def test_ten_thousand_identifiers(spark):
    identifiers = spark.range(10_000).selectExpr("concat('s', id % 100) as supplier", "id % 100 as decl_order", "concat('Agency ', id) as identifier")
    texts = spark.createDataFrame([(1, "to AGENCY 1234."), (2, "agency"), (3, "agency 7 and agency 107 and Agency 9")], "doc_id long, text string")
    got = {r.doc_id: r.supplier for r in matching.detect_suppliers(texts, identifiers).collect()}
    want = plain_suppliers([(r.doc_id, r.text) for r in texts.collect()], [(f"s{i % 100}", i % 100, f"Agency {i}") for i in range(10_000)])
    assert got == want


def test_no_identifiers_or_texts(spark):
    none = spark.createDataFrame([], "supplier string, decl_order int, identifier string")
    texts = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    some = spark.createDataFrame([("s", 0, "a")], none.schema)
    assert matching.detect_suppliers(texts, none).collect() == []
    assert matching.detect_suppliers(texts.limit(0), some).collect() == []


def page(doc, *lines, left=(10, 200, 400)):
    return [(doc, 0, 10 * i + j, t, float(left[j]), 30.0 * i, left[j] + 90.0, 30.0 * i + 20, 1.0, 600.0) for i, line in enumerate(lines) for j, t in enumerate(line) if t is not None]


def grid(doc, *lines):
    return [(doc, 0, i, j, t) for i, line in enumerate(lines) for j, t in enumerate(line)]


def outcome(spark, docs, cells, boxes, broken=None):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = batch.run(made(docs, DOCS), made(cells, CELLS), made(boxes, G.BOXES.replace("doc_id string", "doc_id string")), RULES, 2026, broken)
    rows = sorted((r.doc_id, r.row_idx, r.Date, r.Hotel, r.Total, r.supplier) for r in got.transactions.collect())
    return rows, {r.doc_id: (r.route, r.supplier, r.n_rows, r.error) for r in got.results.collect()}


def test_routes_and_errors(spark):
    long = "word " * 60
    head, line = ["Arrival", "Resort", "Sum"], ["2025-03-04", "Sea Inn", "70"]
    usual = ["Date", "Hotel", "Total"]
    docs = [
        ("read", "a.pdf", "auto", None, "NORTH desk " + long, 1),
        ("scan", "a.pdf", None, None, "", 1),
        ("picture", "a.PNG", "nonsense", "north", None, 1),
        ("own headers", "a.pdf", "text", "auto_detected", "north desk " + long, 1),
        ("unfit", "b.pdf", "ocr", None, long, 1),
        ("bare", "b.pdf", "text", "bare", long, 1),
        ("engine", "b.pdf", "magic", None, long, 1),
        ("kind", "b.txt", "auto", None, long, 1),
        ("noname", None, "auto", None, long, 1),
        ("blank", "b.pdf", "text", None, long, 1),
        ("lost", "b.pdf", "ocr", None, None, None),
        ("broken", "b.jpg", "ocr", None, None, 1),
    ]
    cells = grid("read", head, line) + grid("own headers", usual, line) + grid("bare", usual, line) + grid("blank", ["", "", ""]) + grid("engine", usual, line) + grid("scan", usual, line)
    boxes = page("scan", ["North Desk"], head, line) + page("picture", head, line) + page("unfit", ["north desk"], usual, line) + page("broken", head, line) + page("read", usual, line)
    rows, results = outcome(spark, docs, cells, boxes, spark.createDataFrame([("broken", "cut off"), ("broken", "z")], "doc_id string, error string"))
    good = ["2025-03-04", "Sea Inn", 70.0]
    assert [(r[0], *r[2:5]) for r in rows if r[0] != "bare"] == [(d, *good) for d in ("own headers", "picture", "read", "scan", "unfit")]
    assert results == {
        "read": ("text", "north", 1, None), "scan": ("ocr", "north", 1, None), "picture": ("ocr", "north", 1, None), "own headers": ("text", "auto_detected", 1, None), "unfit": ("ocr", "auto_detected", 1, None),
        "bare": ("text", results["bare"][1], 1, None), "engine": (None, None, 0, "unknown engine: magic"), "kind": (None, None, 0, "unsupported file type: b.txt"), "noname": (None, None, 0, "unsupported file type: "),
        "blank": ("text", None, 0, "no table found"), "lost": ("ocr", None, 0, "no table found"), "broken": ("ocr", None, 0, "cut off"),
    }


def test_empty_batch(spark):
    assert outcome(spark, [], [], []) == ([], {})


def test_broken_answers(spark):
    said = {"a": None, "b": "", "c": "[[", "d": "7", "e": "[1, 2]", "f": '{"x": 1}', "g": '{"rec_texts": ["t"]}', "h": "[]", "i": '[[[[0,0],[1,1]],["t",0.5]]]', "j": '{"rec_texts": null}', "k": '[[[0,0]]]'}
    df = spark.createDataFrame([(d, 0, p) for d, p in said.items()], "doc_id string, page int, payload string")
    got = {r.doc_id: r.error for r in readers.payload_errors(df).collect()}
    assert got == {"a": "payload is not JSON", "b": "payload is not JSON", "c": "payload is not JSON", "d": "payload has no lines", "e": "payload has no lines", "f": "payload has no lines", "j": "payload has no lines", "k": "payload has no lines"}
    assert {r.doc_id for r in readers.decode_payloads(df).collect()} == {"g", "i"}


def test_layouts_do_not_mix(spark):
    """A page whose document belongs to one supplier takes no header of another's; pages of suppliers without layout, and of none, give no cells."""
    labels = spark.createDataFrame([("a", "Arrival"), ("a", "Sum"), ("b", "Day"), ("b", "Amount"), ("b", ""), ("c", "?!")], "supplier string, label string")
    whose = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "doc_id string, supplier string")
    lines = [["Day", "Amount", "Amount"], ["Arrival", "Sum", None], ["x1", "10", None], ["x2", "20", None]]
    boxes = spark.createDataFrame([b for d in "12345" for b in page(d, *lines)], G.BOXES)
    cells, _ = G.template_cells(boxes, labels, whose)
    got = {}
    for r in cells.collect():
        got.setdefault(r.doc_id, {})[r.row_idx, r.col_idx] = r.cell
    assert set(got) == {"1", "2"}
    assert got["1"] == {(0, 0): "Arrival", (0, 1): "Sum", (1, 0): "x1", (1, 1): "10", (2, 0): "x2", (2, 1): "20"}
    assert [got["2"][0, i] for i in range(3)] == ["Day", "Amount", "Amount"]


def test_plan_does_not_grow_with_the_batch(spark):
    """No more Spark jobs for fifty documents than for one."""
    long = "word " * 60

    def jobs(n):
        tracker, group = spark.sparkContext.statusTracker(), f"batch {n}"
        docs = [(f"d{i}", "a.pdf", "text", None, long, 1) for i in range(n)]
        cells = [c for i in range(n) for c in grid(f"d{i}", ["Date", "Hotel", "Total"], ["2025-03-04", "Inn", "7"])]
        spark.sparkContext.setJobGroup(group, group)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            got = batch.run(spark.createDataFrame(docs, DOCS), spark.createDataFrame(cells, CELLS), spark.createDataFrame([], G.BOXES), RULES, 2026)
            assert got.results.where(F.col("n_rows") == 1).count() == n
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(50) <= jobs(1) + 2  # how often a limit looks for rows differs
