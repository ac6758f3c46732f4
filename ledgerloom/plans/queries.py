"""Queries over the star-schema tables, each with the SQL that gives the same rows.

Business tables hold no invoices, so queries first render columns the way invoices show them (texts, cells, boxes, JSON)
and then read them back with this library's operators; the SQL looks at the columns themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions.constants import REPLY_COLUMNS
from ledgerloom.functions.similarity import levenshtein_ratio, similarity_of
from ledgerloom.operators import geometry, mapping, qa, report, standardize, tables
from ledgerloom.plans import pipelines
from ledgerloom.sources import readers
from ledgerloom.sources.rules import Rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _text(c: Column | str) -> Column:
    return _int(c).cast("string")


# Checks of a batch


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), _text("l_quantity").alias("total"), _text("l_linenumber").alias("net"))
    sums = lines.groupBy("doc_id").agg(F.sum(_int("total")).alias("t"), F.sum(_int("net")).alias("n"))
    key = F.col("doc_id")
    footers = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(sums, "doc_id", "left")
    total = F.when(key % 7 != 0, F.coalesce("t", F.lit(0)) + key % 3)
    return qa.review(lines, footers.select("doc_id", total.cast("string").alias("footer_total"), F.coalesce("n", F.lit(0)).cast("string").alias("footer_net")))


_REVIEW = """SELECT o_orderkey AS doc_id, CAST(coalesce(t, 0) AS DOUBLE) AS total_sum, CAST(coalesce(n, 0) AS DOUBLE) AS net_sum,
CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 = 2 THEN 'MISMATCH' WHEN o_orderkey % 7 = 0 THEN 'NO FOOTER' ELSE 'OK' END AS review
FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS t, sum(l_linenumber) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""


@query(_REVIEW)
def review_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices whose footer differs from their rows' sums, or that have none."""
    return _reviewed(spark, sf_dir)


@query(f"SELECT * FROM ({_REVIEW}) WHERE review <> 'OK'")
def flagged_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.flagged(_reviewed(spark, sf_dir))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_orderkey % 11 <> 0) AS succeeded, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS failed FROM orders")
def batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.batch_totals(_t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, "broken").alias("error")))


@query("""SELECT c_nationkey, CAST(1 + max(CAST(c_acctbal > 0 AS INT)) + max(CAST(c_mktsegment = 'BUILDING' AS INT)) AS BIGINT) AS detected
FROM customer GROUP BY c_nationkey""")
def detected_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select("c_nationkey", F.col("c_name").alias("V.NO"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("Total"), F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).otherwise(" ").alias("Hotel"), F.lit(None).cast("string").alias("Net"))
    return qa.detected_columns(rows, ["V.NO", "Total", "Hotel", "Net"], ("c_nationkey",))


# What goes out


@query("""SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 50 WHEN '3' THEN 55 WHEN '4' THEN 65 ELSE 0 END
* CAST(round(o_totalprice) AS BIGINT)::DOUBLE AS egp FROM orders""")
def egp_converter(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount, first = F.round("o_totalprice").cast("bigint").cast("double"), F.substring("o_orderpriority", 1, 1)
    each = {"EGP": "1", "USD": "2", "Euros": "3", "GBP": "4"}
    priced = _t(spark, sf_dir, "orders").select("o_orderkey", *[F.when(first == p, amount).alias(c) for c, p in each.items()])
    return report.with_egp(priced, name="egp").select("o_orderkey", "egp")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_l_quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def subtotal_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.subtotals(_t(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", _int("l_quantity").alias("l_quantity")), ["l_returnflag", "l_linestatus"], ["l_quantity"])


@query("""WITH g AS (SELECT c_mktsegment AS Hotel, count(*) AS "EGP" FROM customer GROUP BY 1)
SELECT Hotel, "EGP", false AS is_total FROM g UNION ALL SELECT 'TOTAL', CAST(sum("EGP") AS BIGINT), true FROM g""")
def total_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_subtotal(_t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("Hotel")).agg(F.count(F.lit(1)).alias("EGP")))


@query("""SELECT column_name, CAST(greatest(10, least(40, w + 2)) AS INT) AS width FROM (
SELECT 'p_name' AS column_name, greatest(max(length(p_name)), 6) AS w FROM part UNION ALL SELECT 'p_type', greatest(max(length(p_type)), 6) FROM part
UNION ALL SELECT 'p_size', greatest(max(length(CAST(p_size AS VARCHAR))), 6) FROM part)""")
def autofit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.column_widths(_t(spark, sf_dir, "part"), ["p_name", "p_type", "p_size"])


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","rate":null}' AS record FROM nation""")
def json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_records(_t(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(float("nan")).alias("rate")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 32")
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = report.keep_newest(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return newest.select("o_orderkey", F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd").alias("day"))


@query("SELECT c_nationkey AS name, c_mktsegment AS size, min(c_custkey) AS id FROM customer GROUP BY 1, 2")
def dedupe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("name"), F.col("c_mktsegment").alias("size"), F.col("c_custkey").alias("id"))
    return report.drop_repeats(files, ["name", "size"], "id")


@query("""SELECT 'c' || c_custkey AS "V.NO", c_mktsegment AS Hotel, NULL::VARCHAR AS Notes FROM customer UNION ALL SELECT 's' || s_suppkey, NULL, s_name FROM supplier""")
def union_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("V.NO"), F.col("c_mktsegment").alias("Hotel"))
    b = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("V.NO"), F.col("s_name").alias("Notes"))
    return standardize.union_frames([a, b])


# Scalars


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 IN (4, 5) THEN -1 ELSE 1 END * CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem""")
def currency_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written in seven ways and read back."""
    price, way = F.format_number(F.round(F.col("l_extendedprice") * 100) / 100, 2), F.col("l_linenumber") % 7
    plain = F.replace(price, F.lit(","), F.lit(""))
    text = F.when(way == 0, price).when(way == 1, F.concat(F.lit("$ "), price)).when(way == 2, F.concat(price, F.lit(" €"))).when(way == 3, F.concat(F.lit("EGP "), plain)).when(way == 4, F.concat(F.lit("( "), price, F.lit(")"))).when(way == 5, F.concat(plain, F.lit("-"))).otherwise(F.concat(price, F.lit(" L.E.")))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.parse_money(text)["num"] * 100).cast("bigint").alias("cents"))


@query("SELECT c_custkey, '9' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS txt, true AS is_text FROM customer")
def currency_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = S.parse_money(F.concat(F.lit("9"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")))
    return _t(spark, sf_dir, "customer").select("c_custkey", money["txt"].alias("txt"), money["num"].isNull().alias("is_text"))


@query("SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem")
def date_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five ways and read back."""
    d, way = F.col("l_shipdate").cast("date"), F.col("l_linenumber") % 5
    forms = ["d-MMM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "EEE d MMM yyyy", "yyyy/M/d"]
    text = F.coalesce(*[F.when(way == i, F.date_format(d, f)) for i, f in enumerate(forms)])
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.parse_date(text, 2026).alias("day"))


@query("""SELECT o_orderkey, coalesce(strftime(try_cast(CASE WHEN d > 12 THEN printf('2026-%02d-%02d', m, d) ELSE printf('2026-%02d-%02d', d, m) END AS DATE), '%Y-%m-%d'), d || '/' || m) AS day
FROM (SELECT o_orderkey, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders)""")
def date_two_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format(F.col("o_orderdate").cast("date"), "d/M")
    return _t(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(text, 2026).alias("day"))


@query("SELECT p_partkey, p_size AS n FROM part")
def count_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", S.to_count(F.concat(F.lit("ad. "), "p_size", F.lit(" + 1"))).alias("n"))


_BLANK = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\(cid:\d+\)', ' ', 'g'), '{_BLANK}+', ' ', 'g'))) AS clean FROM documents")
def clean_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("(cid:12)\t"), F.coalesce("text", F.lit("")), F.lit(" (cid:7)"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(S.clean_cell(noisy).cast("binary")).alias("clean"))


@query(rf"SELECT page_id, regexp_matches(html, '\(cid:\d+\)') OR length(regexp_replace(html, '^{_BLANK}+|{_BLANK}+$', '', 'g')) < 40 * (page_id % 90 + 1) AS ocr FROM pages")
def ocr_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", S.needs_ocr("html", F.col("page_id") % 90 + 1).alias("ocr"))


_LATIN, _ARABIC = "abcdefghijklmnopqrstuvwxyz", "ابتثجحخدذرزسشصضطظعغفقكلمنه"


@query(f"SELECT p_partkey, reverse(translate(lower(p_name), '{_LATIN}', '{_ARABIC}')) AS name FROM part")
def fix_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", S.fix_arabic(F.translate(F.lower("p_name"), _LATIN, _ARABIC)).alias("name"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || ' (' || p_brand || ') التاريخ'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS header FROM part""")
def normalize_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" / "), "p_type", F.lit(" ("), "p_brand", F.lit(") التاريخ"))
    return _t(spark, sf_dir, "part").select("p_partkey", S.normalize_header(text).alias("header"))


_CURRENCIES = {"Cash $": "USD", "Eng$": "GBP", "€": "Euros", "Rest LE": "EGP", "£ paid": "GBP", "EGP Converter": None, "Total $": None, "Hotel": None, "جنيه": "EGP", "us dollars": "USD"}
_VALUES = lambda pairs: ", ".join(f"('{a}', {'NULL' if b is None else repr(b)})" for a, b in pairs)


@query(f"SELECT r_regionkey, header, currency FROM region, (VALUES {_VALUES(_CURRENCIES.items())}) v(header, currency)")
def header_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _t(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, _CURRENCIES))).alias("header"))
    return heads.select("*", S.header_currency("header").alias("currency"))


@query("""SELECT doc_id, col_idx, p_type || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS header FROM (
SELECT p_brand AS doc_id, p_partkey AS col_idx, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS n FROM part)""")
def dedupe_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("col_idx"), F.col("p_type").alias("header"))
    return tables.dedupe_headers(heads, ("doc_id",))


@query("SELECT p_partkey, 'Brand: ' || p_brand || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' | Size: ' || p_size END || ' | ' || p_name AS notes FROM part")
def notes_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("p_size") % 3 == 0, F.lit(" - ")).otherwise(F.col("p_size").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", S.fold_notes([("Brand", F.col("p_brand")), ("Size", size), (None, F.col("p_name")), ("Room", F.lit(None))]).alias("notes"))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CAST(event_id * 1000 AS DOUBLE) END AS n FROM events")
def to_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.format_number(F.col("event_id") * 1000, 0), F.lit(" ")))
    return _t(spark, sf_dir, "events").select("event_id", S.to_number(text).alias("n"))


@query("SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, value) - 1 AS INT) AS pos, value FROM (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value FROM lineitem)")
def split_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers packed in one text, taken apart again."""
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", _text("l_quantity").alias("q"))))
    packed = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(pairs, lambda p: p["q"]), " ").alias("text"))
    return packed.select("l_orderkey", F.posexplode(S.split_numbers("text")).alias("pos", "value"))


@query("SELECT page_id, lower(regexp_extract(url, '(\\.[^./\\\\]+)$', 1)) AS extension, false AS image FROM pages".replace("\\\\.", "\\."))
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").select("page_id", S.file_extension("url").alias("extension"), S.is_image("url").alias("image"))


# Headers and suppliers

_MARKS = {"north": ["because", "house"], "south": ["www", "http", "copyright"], "east": ["de la", " der "]}
_HITS = ", ".join(f"{'+'.join(f'CAST(contains(t, {m!r}) AS INT)' for m in marks)} AS {name}" for name, marks in _MARKS.items())


@query(f"""SELECT doc_id, CASE WHEN greatest(north, south, east) = 0 THEN NULL WHEN north >= south AND north >= east THEN 'north' WHEN south >= east THEN 'south' ELSE 'east' END AS supplier
FROM (SELECT doc_id, {_HITS} FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))""")
def detect_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", mapping.detect_supplier(F.col("text"), _MARKS).alias("supplier"))


_HEADERS = {"Dt": "Date", "Hotel": "Hotel", "Ad.": "Adult", "ch": "Child", "inf": "Inf", "$0": "USD", "EGP -": "EGP", "Cost": "Total", "Eng$": "GBP", "€": "Euros", "Voucher No": "V.NO", "Zorblax Field": None, "Grand Total": None}


def _headers(spark: SparkSession, sf_dir: str, names: list[str], table: str = "nation", key: str = "n_nationkey") -> DataFrame:
    return _t(spark, sf_dir, table).select(F.col(key).alias("doc_id"), F.lit(0).alias("table_id"), F.posexplode(F.array(*map(F.lit, names))).alias("col_idx", "header"))


@query(f"SELECT n_nationkey AS doc_id, header, standard_column FROM nation, (VALUES {_VALUES(_HEADERS.items())}) v(header, standard_column)")
def column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.map_columns(_headers(spark, sf_dir, list(_HEADERS))).select("doc_id", "header", "standard_column")


@query("SELECT p_partkey, round(1 - levenshtein(p_name, p_type)::DOUBLE / greatest(length(p_name), length(p_type)), 6) AS score FROM part")
def fuzzy_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(levenshtein_ratio(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query()
def fuzzy_difflib(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL has no matching-blocks ratio; tests compare the scores with difflib."""
    pairs = _t(spark, sf_dir, "part").select(F.lower("p_name").alias("a"), F.lower("p_type").alias("b")).distinct()
    return pairs.withColumn("score", similarity_of(F.col("a"), F.col("b")))


_PROFILE = {"Arrival": "Date", "Resort": "Hotel", "Grownups": "Adult", "Kids": "Child", "Babies": "Inf", "Ticket": "V.NO", "Dollars": "USD", "Sum": "Total"}


@query(f"""SELECT s_suppkey AS doc_id, count(*) FILTER (WHERE (s_suppkey + i) % 3 > 0) / 8.0::DOUBLE AS coverage, count(*) FILTER (WHERE (s_suppkey + i) % 3 > 0) / 8.0 >= 0.6 AS fits
FROM supplier, range({len(_PROFILE)}) r(i) GROUP BY 1""")
def profile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Rules.of({"suppliers": {"north": {"columns_mapping": _PROFILE}}})
    heads = _headers(spark, sf_dir, list(_PROFILE), "supplier", "s_suppkey").where("(doc_id + col_idx) % 3 > 0").withColumn("supplier", F.lit("north"))
    return mapping.profile_fits(mapping.map_profile(heads, rules)).select("doc_id", "coverage", "fits")


# Grids


def _cells(rows: DataFrame, key: str, row: Column, values: list[Column], table: int = 0) -> DataFrame:
    return rows.select(F.col(key).alias("doc_id"), F.lit(table).alias("table_id"), row.cast("int").alias("row_idx"), F.posexplode(F.array(*[v.cast("string") for v in values])).alias("col_idx", "cell"))


_LINE_HEADER = ["Date", "Hotel", "Adult", "V.NO", "Total", "Room"]


def _order_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each order: a header, its lines in order, and a total row below."""
    order = W.partitionBy("l_orderkey")
    nth = F.row_number().over(order.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    lines = _t(spark, sf_dir, "lineitem").withColumns({"nth": nth, "last": F.count(F.lit(1)).over(order)})
    row = lambda at, values: F.struct(at.cast("int").alias("row_idx"), F.array(*[v.cast("string") for v in values]).alias("cells"))
    head = row(F.lit(0), [F.lit(h) for h in _LINE_HEADER])
    body = row(F.col("nth"), [F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd"), F.concat(F.lit("Hotel "), "l_suppkey"), _int("l_quantity"), F.concat(F.lit("TG-"), "l_partkey"), F.format_number(_int("l_extendedprice"), 0), F.concat(F.lit("Room "), "l_linenumber")])
    total = row(F.col("last") + 1, [F.lit("Total"), *[F.lit("")] * 3, F.lit("600"), F.lit("")])
    # The first line brings the header along and the last one the total, so all of an order comes from one exchange and stays together.
    rows = F.array_compact(F.array(F.when(F.col("nth") == 1, head), body, F.when(F.col("nth") == F.col("last"), total)))
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_id"), F.inline(rows)).select("doc_id", "table_id", "row_idx", F.posexplode("cells").alias("col_idx", "cell"))


@query("SELECT l_orderkey AS doc_id, count(*) AS n_rows FROM lineitem GROUP BY 1")
def drop_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _order_grids(spark, sf_dir)
    headers = grid.where("row_idx = 0").withColumnRenamed("cell", "header").drop("row_idx")
    kept = tables.drop_summary_rows(grid.where("row_idx > 0"), headers)
    return kept.groupBy("doc_id").agg(F.count_distinct("row_idx").alias("n_rows"))


@query("SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS row_idx, strftime(l_shipdate, '%Y-%m-%d') AS \"Date\", 'Hotel ' || l_suppkey AS Hotel, CAST(l_quantity AS INT) AS Adult, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS DOUBLE) AS Total, 'Room: Room ' || l_linenumber AS Notes FROM lineitem")
def standard_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with headers and totals all the way to the standard schema."""
    found = pipelines.extract(_order_grids(spark, sf_dir), fix_arabic=False, together=True)
    return pipelines.format_dynamic(found, 2026).select("doc_id", "row_idx", "Date", "Hotel", "Adult", "Total", "Notes")


@query("SELECT o_orderkey AS doc_id, 'Total Invoice' AS label, CAST(o_custkey AS DOUBLE) AS value_num, NULL::VARCHAR AS value_text FROM orders WHERE o_orderkey % 2 = 0")
def summary_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, label = _t(spark, sf_dir, "orders"), F.when(F.col("o_orderkey") % 2 == 0, "Total Invoice").otherwise("Room")
    grid = _cells(orders, "o_orderkey", F.lit(0), [label, F.concat(F.format_number("o_custkey", 0), F.lit(" $"))])
    blocks = tables.summary_tables(grid)
    return tables.summary_values(grid.join(blocks, list(tables.TABLE), "left_semi"))


@query("""SELECT o_orderkey AS doc_id, 'INVOICE NO' AS label, NULL::DOUBLE AS value_num, '9' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS value_text FROM orders
UNION ALL SELECT o_orderkey, 'INVOICE DATE', NULL, strftime(o_orderdate, '%Y-%m-%d') FROM orders
UNION ALL SELECT o_orderkey, 'TOTAL', CAST(o_custkey AS DOUBLE), NULL FROM orders""")
def meta_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders")
    strip = _cells(orders, "o_orderkey", F.lit(0), [F.lit(h) for h in ("TOTAL", "INVOICE DATE", "INVOICE NO")])
    values = _cells(orders, "o_orderkey", F.lit(1), [F.format_number("o_custkey", 0), F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.concat(F.lit("9"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"))])
    data = _cells(orders, "o_orderkey", F.lit(2), [F.lit("Date"), F.lit("Hotel"), F.lit("Total")])
    return tables.split_metadata(strip.unionByName(values).unionByName(data))[1]


@query("SELECT o_orderkey AS doc_id, CAST(o_orderkey % 2 AS INT) AS header_idx FROM orders")
def header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with and without a title above the header."""
    orders = _t(spark, sf_dir, "orders")
    at = F.col("o_orderkey") % 2
    title = _cells(orders.where("o_orderkey % 2 = 1"), "o_orderkey", F.lit(0), [F.lit("Invoice"), F.lit(""), F.lit(""), F.lit("")])
    head = _cells(orders, "o_orderkey", at, [F.lit("Date"), F.lit("Hotel"), F.lit("Room"), F.lit("Cost")])
    body = _cells(orders, "o_orderkey", at + 1, [F.lit("1-Sep"), F.col("o_orderpriority"), F.lit("12"), _int("o_totalprice")])
    return tables.header_rows(title.unionByName(head).unionByName(body)).select("doc_id", "header_idx")


# Boxes


def _page(df: DataFrame, doc: Column, box: Column, text: Column, x0: Column, y0: Column, x1: Column, y1: Column, width: float) -> DataFrame:
    d = lambda c: c.cast("double")
    return df.select(doc.alias("doc_id"), F.lit(0).alias("page"), box.cast("int").alias("box_id"), text.alias("text"), d(x0).alias("x0"), d(y0).alias("y0"), d(x1).alias("x1"), d(y1).alias("y1"), F.lit(1.0).alias("confidence"), F.lit(width).alias("page_width"))


@query("""SELECT event_id, CAST(sum(part) OVER (PARTITION BY user_id ORDER BY moment, event_id ROWS UNBOUNDED PRECEDING) AS INT) AS island FROM (
SELECT event_id, user_id, moment, coalesce(CAST(moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id) > 40000000000 AS INT), 0) AS part FROM (SELECT event_id, user_id, epoch_us(ts) AS moment FROM events))""")
def row_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    rows = _t(spark, sf_dir, "events").select("event_id", "user_id", at.alias("at"))
    return geometry.islands(rows, ["user_id"], F.col("at"), F.lit(40_000_000_000), ["event_id"], "island").select("event_id", "island")


@query("""WITH g AS (SELECT user_id, CAST(event_id % 97 + (event_id % 2) * 500 AS DOUBLE) AS v FROM events),
s AS (SELECT user_id, v, row_number() OVER w AS i, sum(v) OVER (PARTITION BY user_id ORDER BY v ROWS UNBOUNDED PRECEDING) AS s, lead(v) OVER w AS next,
count(*) OVER (PARTITION BY user_id) AS n, sum(v) OVER (PARTITION BY user_id) AS a FROM g WINDOW w AS (PARTITION BY user_id ORDER BY v)),
b AS (SELECT user_id, (v + next) / 2 AS threshold, row_number() OVER (PARTITION BY user_id ORDER BY (i / n) * (1 - i / n) * pow(s / i - (a - s) / (n - i), 2) DESC, i) AS k FROM s WHERE i < n)
SELECT u.user_id, threshold FROM (SELECT DISTINCT user_id FROM g) u LEFT JOIN b ON b.user_id = u.user_id AND k = 1""")
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = _t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 97 + F.col("event_id") % 2 * 500).cast("double").alias("v"))
    return geometry.otsu(values, ["user_id"], "v")


def _event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("event_id") * 37 % 880
    return _page(_t(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.col("event_type"), left, F.lit(0), left + 6, F.lit(10), 1000.0)


@query("""WITH s AS (SELECT user_id, event_id * 37 % 880 AS b0, event_id * 37 % 880 + 6 AS b1 FROM events),
p AS (SELECT *, coalesce(CAST(b0 > max(b1) OVER (PARTITION BY user_id ORDER BY b0, b1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 11 AS INT), 0) AS part FROM s),
n AS (SELECT *, CAST(sum(part) OVER (PARTITION BY user_id ORDER BY b0, b1 ROWS UNBOUNDED PRECEDING) AS INT) AS band FROM p)
SELECT user_id AS doc_id, band, CAST(min(b0) AS DOUBLE) AS b0, CAST(max(b1) AS DOUBLE) AS b1 FROM n GROUP BY 1, 2""")
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.column_bands(_event_boxes(spark, sf_dir)).select("doc_id", "band", "b0", "b1")


@query("""SELECT CAST(event_id AS INT) AS box_id, CAST(arg_min(band, (-greatest(least(x + 6, 180 * band + 170) - greatest(x, 180 * band), 0), CASE WHEN least(x + 6, 180 * band + 170) > greatest(x, 180 * band) THEN 0 ELSE abs(x + 3 - 180 * band - 85) END, band)) AS INT) AS band
FROM (SELECT event_id, event_id * 37 % 880 AS x FROM events), range(5) r(band) GROUP BY event_id""")
def band_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _event_boxes(spark, sf_dir)
    bands = boxes.select("doc_id", "page").distinct().select("*", F.posexplode(F.array(*[F.lit(180.0 * i) for i in range(5)])).alias("band", "b0"))
    return geometry.assign_bands(boxes, bands.withColumn("b1", F.col("b0") + 170)).select("box_id", "band")


@query("""WITH t AS (SELECT *, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS text FROM lineitem),
q AS (SELECT l_orderkey AS doc_id, text, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, text) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM t)
SELECT doc_id, text, round(i * 20.0::DOUBLE / n, 6) AS y0 FROM q WHERE n >= 3 UNION ALL SELECT doc_id, string_agg(text, ' ' ORDER BY i), 0.0 FROM q WHERE n < 3 GROUP BY 1""")
def expand_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("l_linenumber", _text("l_quantity").alias("q"))))
    packed = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(pairs, lambda p: p["q"]), " ").alias("text"))
    boxes = _page(packed, F.col("l_orderkey"), F.lit(0), F.col("text"), F.lit(0), F.lit(0), F.lit(90), F.lit(20), 100.0)
    return geometry.expand_packed(boxes).select("doc_id", "text", F.round("y0", 6).alias("y0"))


@query("""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey, band ORDER BY o_orderkey) - 1 AS INT) AS line, band, band || ':' || o_orderkey AS cell FROM orders, range(3) r(band)""")
def backbone_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", row.alias("row"))
    pieces = orders.select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page"), F.posexplode(F.array(*[F.concat(F.lit(f"{b}:"), "o_orderkey") for b in range(3)])).alias("band", "text"), (F.col("row") * 20.0).alias("y"))
    heights = pieces.select("doc_id", "page").distinct().withColumn("median", F.lit(10.0))
    return geometry.snap_rows(pieces, heights).select("doc_id", "line", F.col("band").cast("bigint").alias("band"), "cell")


@query("SELECT event_id AS doc_id, event_type AS text, CAST(user_id AS DOUBLE) AS x0, CAST(user_id + 5 AS DOUBLE) AS x1, CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM events")
def recognizer_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both shapes of recognizer answers, with and without scores."""
    e = _t(spark, sf_dir, "events")
    points = F.format_string("[[%d,1],[%d,1],[%d,9],[%d,9]]", "user_id", F.col("user_id") + 5, F.col("user_id") + 5, "user_id")
    old = F.concat(F.lit("[["), points, F.lit(',["'), "event_type", F.lit('",0.5]]]'))
    new = lambda scores: F.concat(F.lit('{"rec_texts":["'), "event_type", F.lit(f'"],{scores}"dt_polys":['), points, F.lit("]}"))
    kind = F.col("event_id") % 3
    payload = F.when(kind == 0, new("")).when(kind == 1, new('"rec_scores":[0.5],')).otherwise(old)
    return readers.decode_payloads(e.select(F.col("event_id").alias("doc_id"), F.lit(0).alias("page"), payload.alias("payload"))).select("doc_id", "text", "x0", "x1", "confidence")


@query("SELECT l_orderkey AS doc_id, string_agg('Page ' || l_linenumber || '  end', chr(10) ORDER BY l_linenumber) AS text, count(*) AS pages FROM lineitem GROUP BY 1")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat(F.lit("Page "), "l_linenumber", F.lit(" (cid:3)end")).alias("text"))
    return readers.page_text(pages)


_BOX_HEADER = {"Date": 10, "Hotel": 200, "Adult": 450, "Total": 700}


@query("SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_idx, strftime(o_orderdate, '%Y-%m-%d') AS \"Date\", 'Hotel ' || o_orderkey AS Hotel, CAST(o_orderkey % 9 + 1 AS INT) AS Adult, CAST(o_orderkey * 3 AS DOUBLE) AS Total FROM orders")
def page_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of boxes for each customer: header, rows, columns found from the layout, then the standard schema."""
    row = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    values = F.array(F.date_format(F.col("o_orderdate").cast("date"), "d-MMM-yyyy"), F.concat(F.lit("Hotel "), "o_orderkey"), (F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_orderkey") * 3).cast("string"))
    rows = _t(spark, sf_dir, "orders").select("o_custkey", row.alias("row"), values.alias("values"))
    heads = rows.where("row = 1").select("o_custkey", F.lit(0).alias("row"), F.array(*map(F.lit, _BOX_HEADER)).alias("values"))
    each = rows.unionByName(heads).select("o_custkey", "row", F.posexplode("values").alias("col", "text"))
    left = F.array(*map(F.lit, _BOX_HEADER.values()))[F.col("col")]
    boxes = _page(each, F.col("o_custkey"), F.col("row") * 4 + F.col("col"), F.col("text"), left, F.col("row") * 30, left + 120, F.col("row") * 30 + 20, 900.0)
    return pipelines.boxes_to_transactions(boxes, 2026)[0].select("doc_id", "row_idx", "Date", "Hotel", "Adult", "Total")


# Replies


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey AS doc_id, CAST(CASE l_orderkey % 5 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE n END AS INT) AS n_rows, CASE l_orderkey % 5 WHEN 2 THEN 'wrong keys in a row' WHEN 3 THEN 'not JSON' END AS error,
CASE l_orderkey % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'MISMATCH' WHEN 4 THEN 'NO FOOTER' END AS review FROM l""")
def json_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON replies, plain and fenced, good and broken, checked against their footers."""
    kind = F.col("l_orderkey") % 5
    given = {"Hotel": F.concat(F.lit("H"), "l_suppkey"), "Total": F.col("l_linenumber").cast("string"), "Net": F.lit("0")}
    row = F.create_map(*[x for c in REPLY_COLUMNS for x in (F.lit(c), given.get(c, F.lit("")))])
    short = F.map_filter(row, lambda k, _: k != "Hotel")
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(kind == 2, short).otherwise(row)).alias("rows"), F.sum("l_linenumber").alias("s"))
    total = F.when(kind == 1, F.col("s") + 5).when(kind != 4, F.col("s")).cast("string")
    body = F.to_json(F.struct("rows", F.struct(total.alias("total"), F.lit("0").alias("net")).alias("footer")))
    reply = F.when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 3, "Sorry, no table here.").otherwise(body)
    return pipelines.review_replies(lines.select(F.col("l_orderkey").alias("doc_id"), reply.alias("reply")))[1].select("doc_id", "n_rows", "error", "review")
