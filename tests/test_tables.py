import random

import pytest

from ledgerloom.functions.constants import STANDARD_COLUMNS
from ledgerloom.operators import mapping as M
from ledgerloom.operators import tables as T
from ledgerloom.plans import pipelines as P
from ledgerloom.sources.rules import Rules, rule_tables

CELLS = "doc_id string, table_id int, row_idx int, col_idx int, cell string"


def grid(spark, *tables, doc="d"):
    rows = [(doc, t, r, c, cell) for t, table in enumerate(tables) for r, row in enumerate(table) for c, cell in enumerate(row)]
    return spark.createDataFrame(rows, CELLS)


MOCK = [["Dt", "Hotel", "Ad.", "ch", "inf", "$0", "EGP -", "Cost"], ["1-Sep", "Hurghada", "2", "1", "0", "100", "0", "100"], ["2-Sep", "Cairo", "1", "0", "0", "0", "500", "500"], ["Total", "", "", "", "", "", "", "600"]]
SUMMARY = [["Total Invoice", "600"], ["Net Invoice", "600"]]
STRIP = [["TOTAL", "RECORDS", "PERIOD", "RECIPIENT", "INVOICE DATE", "INVOICE NO"], ["-10,353 LE", "27 items", "2026-09-10", "Someone", "Sep 13, 2026", "2609131157"]]
MAIN = [["Date", "Hotel", "Adults", "Egy LE", "Total", "Notes / Details"], ["2026-09-10", "Hilton", "2", "2400", "2600", "TG2026-5315"], ["2026-09-11", "Marriott", "1", "1500", "1800", "TG2026-6339"]]


def dynamic(spark, *tables, fix_arabic=True):
    found = P.extract(grid(spark, *tables), fix_arabic)
    rows = P.format_dynamic(found, 2026).orderBy("table_id", "row_idx").collect()
    return rows, {r.label: r.value_num if r.value_num is not None else r.value_text for r in found.summary.collect()}


def test_unknown_layout(spark):
    rows, summary = dynamic(spark, MOCK, SUMMARY)
    assert [[r[c] for r in rows] for c in ("Hotel", "Adult", "Child", "Inf", "USD", "EGP", "Total", "Date")] == [["Hurghada", "Cairo"], [2, 1], [1, 0], [0, 0], [100.0, 0.0], [0.0, 500.0], [100.0, 500.0], ["2026-09-01", "2026-09-02"]]
    assert summary == {"Total Invoice": 600.0, "Net Invoice": 600.0}
    assert rows[0].asDict().keys() >= set(STANDARD_COLUMNS)


def test_arabic_headers(spark):
    rows, _ = dynamic(spark, [["التاريخ", "الفندق", "بالغ", "طفل"], ["1-Sep", "الغردقة", "2", "1"], ["2-Sep", "القاهرة", "1", "0"]])
    assert [(r.Adult, r.Child) for r in rows] == [(2, 1), (1, 0)]


def test_metadata_strip(spark):
    rows, summary = dynamic(spark, STRIP, MAIN, fix_arabic=False)
    assert summary["INVOICE NO"] == "2609131157" and summary["TOTAL"] == -10353.0
    assert len(rows) == 2 and rows[0].EGP == 2400.0 and rows[0]["EGP Converter"] is None
    assert not any("2609131157" in str(v) for r in rows for v in r)


def test_empty_and_odd_tables(spark):
    empty = grid(spark, [["a"]]).limit(0)
    found = P.extract(empty)
    assert P.format_dynamic(found, 2026).collect() == [] and found.summary.collect() == []
    wide = [[f"Head{chr(97 + i)}" for i in range(26)]] + [[str(i) if i < 8 else "" for i in range(26)] for _ in range(3)]
    assert len(dynamic(spark, wide)[0]) == 3
    narrow = [["Date", "Hotel", "Adult", "Child"], ["1-Sep", "Rixos", "1", "0"], [None, None, None, None]]
    assert len(dynamic(spark, narrow)[0]) == 1
    assert [r.value_text for r in T.summary_values(grid(spark, [["Total"]])).collect()] == [None]


def test_header_row_and_second_header(spark):
    titled = [["Invoice", "", "", ""], ["Date", "Hotel", "cash", ""], ["", "", "L.E", "euro"], ["1-Sep", "Rixos", "10", "20"]]
    cells = T.clean_cells(grid(spark, titled))
    assert T.header_rows(cells).first().header_idx in (1, 3)
    plain = [["Title", "", "", ""], ["Date", "Hotel", "Room", "Cost"], ["1-Sep", "Rixos", "a", "20"]]
    assert T.header_rows(T.clean_cells(grid(spark, plain))).first().header_idx == 1
    two = [["Date", "Hotel", "cash", "", "Guest"], ["", "", "L.E", "euro", ""], ["1-Sep", "Rixos", "10", "20", ""]]
    headers, body = T.to_frames(T.clean_cells(grid(spark, two)))
    assert [r.header for r in headers.orderBy("col_idx").collect()] == ["Date", "Hotel", "cash L.E", "euro", "Guest"]
    assert {r.row_idx for r in body.collect()} == {2}


def test_names_are_unique(spark):
    rows = [("d", 0, i, h) for i, h in enumerate(["A", "A", "A_1", "", "", None])]
    got = [r.header for r in T.dedupe_headers(spark.createDataFrame(rows, "doc_id string, table_id int, col_idx int, header string")).orderBy("col_idx").collect()]
    assert len(set(got)) == 6 and got[0] == "A"


def test_names_of_a_wide_table_are_settled_without_gathering_it(spark):
    def one_by_one(names: list[str]) -> list[str]:
        seen, out, all_names = {}, [], set(names)
        for h in names:
            n = seen[h] = seen.get(h, -1) + 1
            while n and (f"{h}_{n}" in all_names or f"{h}_{n}" in out):
                n += 1
            out.append(f"{h}_{n}" if n else h)
        return out

    rng = random.Random(5)
    tables = {f"d{t}": [rng.choice(["A", "A_1", "A_2", "A_3", "A_5", "A_1_1", "B", "_1", "A_01", "A\nB", "A\nB_1"]) for _ in range(40)] for t in range(20)}
    rows = [(d, 0, i, h) for d, names in tables.items() for i, h in enumerate(names)]
    found = T.dedupe_headers(spark.createDataFrame(rows, "doc_id string, table_id int, col_idx int, header string"))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = {(r.doc_id, r.col_idx): r.header for r in found.collect()}
    assert got == {(d, i): h for d, names in tables.items() for i, h in enumerate(one_by_one(names))}


RULES = Rules.of({"suppliers": {"north": {"identifiers": ["North Gate"], "columns_mapping": {"Date": "Date", "Notes / Details": "V.NO", "Egy LE": "EGP", "Total": "Total"}, "notes_columns": {"Hotel": "Stay"}}}})


@pytest.mark.parametrize("who", ["north gate invoice", "someone else"])
def test_mixed_batch_picks_its_way(spark, who):
    noisy = [["Date", "Hotel", "Adults", "Egy LE", "Total", "Notes/Details"], *MAIN[1:]]
    cells = grid(spark, noisy)
    texts = spark.createDataFrame([("d", who)], "doc_id string, text string")
    rows = P.transactions(cells, texts, RULES, 2026)[0].orderBy("row_idx").collect()
    if who.startswith("north"):
        assert rows[0].strategy == "profile" and rows[0]["V.NO"] == "TG2026-5315" and rows[0].Notes == "Stay: Hilton" and rows[0].EGP == 2400.0
    else:
        assert rows[0].strategy == "dynamic" and rows[0].Hotel == "Hilton" and rows[0].Adult == 2


def test_rule_tables(spark, tmp_path):
    from ledgerloom.sources.rules import load_rules

    (tmp_path / "r.yaml").write_text("suppliers:\n  a:\n    identifiers: [x, y]\n    columns_mapping: {H: Hotel}\n    notes_columns: {R: Room}\n")
    rules = load_rules(tmp_path / "r.yaml")
    t = rule_tables(spark, rules)
    assert [r.identifier for r in t["supplier_identifiers"].collect()] == ["x", "y"]
    assert t["supplier_columns"].first().standard_column == "Hotel" and rules.suppliers["a"].header_names == ["H", "R"]
    assert M.alias_pairs()[0][0] == "EGP Converter"


def test_summary_rows_are_found_with_one_exchange(spark):
    """Headers and cells meet inside their tables: nothing but tables is moved, whatever the sizes; null places and tables without headers stay."""
    cells = [(d, 0, r, c, t) for d in ("a", "b") for r, line in enumerate([("Hotel", "x", "1"), ("TOTAL", "", "9"), ("Inn", "y", "2"), ("", "z", "")], 1) for c, t in enumerate(line)]
    cells += [(None, 0, 1, 0, "Total"), ("c", None, 1, 0, "Total")]
    body = spark.createDataFrame(cells, "doc_id string, table_id int, row_idx int, col_idx int, cell string")
    headers = spark.createDataFrame([("a", 0, c, h) for c, h in enumerate(("hotel ", "N", "V"))], "doc_id string, table_id int, col_idx int, header string")
    kept = T.drop_summary_rows(body, headers, min_filled=None)
    assert sorted({(r.doc_id, r.table_id, r.row_idx) for r in kept.collect()}, key=repr) == sorted([("a", 0, 3), *[("b", 0, r) for r in (1, 2, 3, 4)], (None, 0, 1), ("c", None, 1)], key=repr)
    assert kept.columns == body.columns and kept.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
