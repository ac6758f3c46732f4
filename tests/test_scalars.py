import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions.similarity import best_match, label_similarity, levenshtein_ratio, similarity
from ledgerloom.operators import mapping as M


def over(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v")).alias("out")).collect()]


MONEY = {"2609131157": "2609131157", "915-": -915.0, "-10,353 LE": -10353.0, "2,400": 2400.0, "( 23,756.00)": -23756.0, "-": None, "": None, None: None, "$ 7 5": 75.0, "63 €": 63.0, "EGP 4,600": 4600.0, "€ 310": 310.0, "1,300 L.E.": 1300.0, "abc  12 x": "abc 12 x", "٤٥٠": 450.0, "$ 2609131157": 2609131157.0}


def test_money(spark):
    got = over(spark, list(MONEY), S.parse_money)
    assert [r.num if r.num is not None else r.txt for r in got] == list(MONEY.values())
    assert over(spark, ["( 23,756.00)", "7.50 $", "x", None], S.money_text) == ["-23756", "7.5", "x", ""]


DATES = {"1-Sep": "2026-09-01", "1 Sep 2025": "2025-09-01", "1-Sep-25": "2025-09-01", "Thursday 1-Sep": "2026-09-01", "Thu 1-Sep": "2026-09-01", "15/09/2024": "2024-09-15", "2024-9-5": "2024-09-05", "09/01": "2026-09-01", "15/09": "2026-09-15", "31-Feb": "31-Feb", "1-Xyz": "1-Xyz", "01/09/26": "01/09/26", "soon": "soon", "": "", None: None}


def test_dates(spark):
    assert over(spark, list(DATES), lambda c: S.parse_date(c, 2026)) == list(DATES.values())


def test_numbers_and_counts(spark):
    assert over(spark, ["1,234.50", " 7 ", "5d", "nan", "", None, "-3", "1e3"], S.to_number) == [1234.5, 7.0, None, None, None, None, -3.0, 1000.0]
    assert over(spark, ["2 (2MOTO)", "x", None, "٣ فرد"], S.to_count) == [2, 0, 0, 3]


SPLITS = {
    "888- 681- 1,493- 991-": ["888-", "681-", "1,493-", "991-"], "888 681 1,493 991": ["888", "681", "1,493", "991"], "888-681-1,493-991-": ["888-", "681-", "1,493-", "991-"],
    "888-681-1493-991": ["888", "681", "1493", "991"], "888 - 681 - 1,493 - 991": ["888", "681", "1,493", "991"], "-888 -681 -1,493": ["-888", "-681", "-1,493"],
    "100.50 200.75 300.00": ["100.50", "200.75", "300.00"], "888-": ["888-"], "2026-09-10": ["2026-09-10"], "10/09/2026": ["10/09/2026"], "Hilton - Room 101": ["Hilton - Room 101"], "2609131157": ["2609131157"], "": [], None: [],
}


def test_packed_numbers(spark):
    assert over(spark, list(SPLITS), S.split_numbers) == list(SPLITS.values())


def test_cells_and_scripts(spark):
    assert over(spark, ["(cid:12) 5 (cid:34)", " a \n b ", None], S.clean_cell) == ["5", "a b", ""]
    assert over(spark, ["hello (cid:12) world", "x", None], S.has_cid) == [True, False, False]
    assert over(spark, ["ىدايعلا رون", "1 ,300 . م.ج", None], S.fix_arabic) == ["نور العيادى", "1 ,300 . م.ج", ""]
    assert over(spark, ["Dt.", "Notes / Details", "التاريخ!", None], S.normalize_header) == ["dt", "notes details", "التاريخ", ""]
    assert over(spark, ["a.PDF", "b.jpeg", "c.txt", None], S.is_document) == [True, True, False, False]
    assert over(spark, ["a.PDF", "b.jpeg", "c.PNG", "d"], S.is_image) == [False, True, True, False]
    assert over(spark, ["x" * 39, "x" * 40, "x" * 80 + "(cid:1)"], lambda c: S.needs_ocr(c, F.lit(1))) == [True, False, True]


CURRENCY = {"$0": "USD", "REST €": "Euros", "cash L.E": "EGP", "Egyptian Pounds": "EGP", "£0": "GBP", "Eng$": "GBP", "EUE": "Euros", "Cost $": None, "EGP Converter": None, "Hotel": None, "": None}


def test_header_currency(spark):
    assert over(spark, list(CURRENCY), S.header_currency) == list(CURRENCY.values())
    assert over(spark, ["Total", "Dive2", "Hotel", "Date", "Room cost", "Adults", ""], S.is_numeric_header) == [True, True, False, False, True, True, False]


def test_similarity(spark):
    assert similarity("date", "date") == 1 and similarity("", "x") == 0 and 0.61 < similarity("tour date", "date") < 0.62
    assert label_similarity("hot", "hotel") == 0.80 and label_similarity("egy", "egy le") == 1.0
    df = spark.createDataFrame([("dt",), ("zorblax field",), (None,)], "h string")
    rows = [r.b for r in df.select(best_match(F.col("h"), M.alias_pairs()).alias("b")).collect()]
    assert rows[0].name == "Date" and rows[0].score == 1 and rows[1].score < 0.8 and rows[2].name is None
    assert spark.range(1).select(levenshtein_ratio(F.lit("abcd"), F.lit("abxd"))).first()[0] == 0.75


HEADERS = {"Dt": "Date", "DT.": "Date", "date": "Date", "Date of Service": "Date", "service date": "Date", "التاريخ": "Date", "خيراتلا": "Date", "Ad.": "Adult", "Voucher No": "V.NO", "Cost": "Total", "Cost $": "Total", "Zorblax Field": None, "Eng$": "GBP"}


@pytest.mark.parametrize("header", HEADERS)
def test_single_headers_map(spark, header):
    df = spark.createDataFrame([("d", 0, 0, header)], "doc_id string, table_id int, col_idx int, header string")
    assert M.map_columns(df).first().standard_column == HEADERS[header]


def test_each_column_is_claimed_once(spark):
    names = ["Date", "Dt", "$0", "USD", "Total", "Cost"]
    df = spark.createDataFrame([("d", 0, i, h) for i, h in enumerate(names)], "doc_id string, table_id int, col_idx int, header string")
    got = {r.header: r.standard_column for r in M.map_columns(df).collect()}
    assert got == {"Date": "Date", "Dt": None, "$0": "USD", "USD": None, "Total": "Total", "Cost": None}


def test_suppliers(spark):
    marks = {"north": ["North Gate", "Blue"], "south": ["north gate"], "east": ["Voucher"]}
    got = over(spark, ["x NORTH GATE y", "blue north gate", "voucher", "none", None], lambda c: M.detect_supplier(c, marks))
    assert got == ["north", "north", "east", None, None]
    assert over(spark, ["a", None], M.supplier_label) == ["a (profile)", "Unknown (Smart Fallback)"]
    assert M.resolve_keys(["Dates", "Notes/Details", "Total"], ["Date", "Notes / Details", "Missing"]) == [0, 1, -1]
