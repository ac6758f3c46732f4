"""More queries, like those of ``queries``: known layouts, mixed batches, and what stands around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions.similarity import label_similarity, similarity_of
from ledgerloom.operators import geometry, mapping, qa, standardize, tables
from ledgerloom.plans import pipelines
from ledgerloom.plans.queries import _BOX_HEADER, _cells, _headers, _page, _t, query
from ledgerloom.sources import readers
from ledgerloom.sources.rules import Rules


def _values(rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(one, r))})" for r in rows)


# Known layouts


def _template_boxes(spark: SparkSession, sf_dir: str, packed: bool = False) -> DataFrame:
    """A page for each customer under a header known beforehand; every fourth order names no adults, so that column has fewer boxes than rows."""
    row = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    values = F.array(F.date_format(F.col("o_orderdate").cast("date"), "d-MMM-yyyy"), F.concat(F.lit("Hotel "), "o_orderkey"), F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 9 + 1).cast("string")), (F.col("o_orderkey") * 3).cast("string"))
    rows = _t(spark, sf_dir, "orders").select("o_custkey", row.alias("row"), values.alias("values"))
    if packed:
        # The totals of a page stand in one tall box, as recognizers sometimes read a column.
        last = rows.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.col("values")[3].alias("t")))), lambda x: x["t"]), " ").alias("text"), F.max("row").alias("last"))
        column = last.select("o_custkey", F.lit(1).alias("row"), F.lit(3).alias("col"), "text", (F.col("last") * 30 - 10).alias("tall"))
        rows = rows.withColumn("values", F.slice("values", 1, 3))
    heads = rows.where("row = 1").select("o_custkey", F.lit(0).alias("row"), F.array(*map(F.lit, _BOX_HEADER)).alias("values"))
    each = rows.unionByName(heads).select("o_custkey", "row", F.posexplode("values").alias("col", "text")).where("text is not null").withColumn("tall", F.lit(20))
    if packed:
        each = each.unionByName(column)
    left = F.array(*map(F.lit, _BOX_HEADER.values()))[F.col("col")]
    return _page(each, F.col("o_custkey"), F.col("row") * 4 + F.col("col"), F.col("text"), left, F.col("row") * 30, left + 120, F.col("row") * 30 + F.col("tall"), 900.0)


_TEMPLATE_ROWS = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_idx, o_orderkey, o_orderdate FROM orders"


@query(f"""SELECT doc_id, row_idx, strftime(o_orderdate, '%Y-%m-%d') AS "Date", 'Hotel ' || o_orderkey AS Hotel, CAST(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 + 1 ELSE 0 END AS INT) AS Adult, CAST(o_orderkey * 3 AS DOUBLE) AS Total FROM ({_TEMPLATE_ROWS})""")
def template_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cut by a known header; a column with fewer boxes than rows is placed on the rows nearest to them."""
    return pipelines.boxes_to_transactions(_template_boxes(spark, sf_dir), 2026, list(_BOX_HEADER))[0].select("doc_id", "row_idx", "Date", "Hotel", "Adult", "Total")


@query(f"""SELECT doc_id, row_idx, CASE band WHEN 0 THEN strftime(o_orderdate, '%-d-%b-%Y') WHEN 1 THEN 'Hotel ' || o_orderkey WHEN 2 THEN CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 9 + 1 AS VARCHAR) ELSE '' END ELSE CAST(o_orderkey * 3 AS VARCHAR) END AS cell, band AS col_idx
FROM ({_TEMPLATE_ROWS}), (SELECT CAST(unnest(range(4)) AS INT) AS band)
UNION ALL SELECT doc_id, 0, header, col_idx FROM (SELECT DISTINCT o_custkey AS doc_id FROM orders), (VALUES {_values([(h, i) for i, h in enumerate(_BOX_HEADER)])}) v(header, col_idx)""")
def template_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of known pages whose totals were read as one tall box; row 0 is the header."""
    return geometry.template_cells(_template_boxes(spark, sf_dir, packed=True), list(_BOX_HEADER))[0].select("doc_id", "row_idx", "cell", "col_idx")


@query("""WITH r AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT doc_id, CAST(i AS INT) AS line, band, band || ':' || o_orderkey AS cell FROM r, range(3) b(band) WHERE band = 0 OR o_orderkey % 4 <> band
UNION ALL SELECT doc_id, -1, 1, 'far' FROM r GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 4 = 1) >= 2""")
def snap_sparse_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips that lack pieces, each a little off its row, and one piece that no row can reach (where its strip still is shorter than the rows)."""
    row = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", row.alias("row"))
    shift = F.when(F.col("band") == 0, 0.0).otherwise((F.col("o_orderkey") % 7 - 3).cast("double"))
    texts = F.array(*[F.concat(F.lit(f"{b}:"), "o_orderkey") for b in range(3)])
    pieces = orders.select("*", F.posexplode(texts).alias("band", "text")).where("band = 0 or o_orderkey % 4 <> band").select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page"), "band", "text", (F.col("row") * 20.0 + shift).alias("y"))
    short = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count_if(F.col("o_orderkey") % 4 == 1).alias("less"), F.max("row").alias("last")).where("less >= 2")
    far = short.select("doc_id", F.lit(0).alias("page"), F.lit(1).alias("band"), F.lit("far").alias("text"), (F.col("last") * 20.0 + 500).alias("y"))
    heights = pieces.select("doc_id", "page").distinct().withColumn("median", F.lit(10.0))
    return geometry.snap_rows(pieces.unionByName(far), heights).select("doc_id", F.coalesce("line", F.lit(-1)).alias("line"), F.col("band").cast("bigint").alias("band"), "cell")


@query("SELECT event_id AS doc_id, CAST(1000 - 40 AS DOUBLE) AS x0, CAST(1000 - 30 AS DOUBLE) AS x1, CAST(event_id * 37 % 880 AS DOUBLE) AS y0, CAST(event_id * 37 % 880 + 6 AS DOUBLE) AS y1, 1000.0::DOUBLE AS page_width FROM events")
def turned_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("event_id") * 37 % 880
    boxes = _page(_t(spark, sf_dir, "events"), F.col("event_id"), F.lit(0), F.col("event_type"), left, F.lit(30), left + 6, F.lit(40), 900.0)
    return geometry.rotate(boxes, F.lit(1000.0)).select("doc_id", "x0", "x1", "y0", "y1", "page_width")


@query("""SELECT user_id AS doc_id, count(*) AS boxes, CAST(max(event_id * 37 % 880 + 6) AS DOUBLE) AS max_x1, CAST(max(event_id % 500) AS DOUBLE) AS max_y1, bool_or(contains(event_type, 'c')) AS has_c, bool_or(contains(event_type, 'view')) AS has_view FROM events GROUP BY 1""")
def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("event_id") * 37 % 880
    boxes = _page(_t(spark, sf_dir, "events"), F.col("user_id"), F.col("event_id"), F.upper("event_type"), left, F.lit(0), left + 6, F.col("event_id") % 500, 1000.0)
    return qa.box_statistics(boxes, ("c", "view")).drop("page")


# Batches of known and unknown suppliers

_RULES = {
    "standard_columns": ["Date", "Hotel", "Adult", "V.NO", "Total", "Notes"],
    "suppliers": {
        "north": {"identifiers": ["north desk"], "columns_mapping": {"Arrival": "Date", "Resort": "Hotel", "Grownups": "Adult", "Ticket": "V.NO", "Sum": "Total"}, "notes_columns": {"Remark": "Memo"}},
        "south": {"identifiers": ["south desk"], "columns_mapping": {"A": "Date", "B": "Hotel", "C": "Adult", "D": "V.NO", "E": "Total"}},
    },
}
_NORTH, _OPEN = ["Arrival", "Resort", "Grownups", "Ticket", "Sum", "Remark"], ["Date", "Hotel", "Adult", "V.NO", "Total", "Room"]


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Grids by customer: a third of them in north's layout, a third that name south but don't have its headers, a third that name nobody."""
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = _t(spark, sf_dir, "orders").withColumn("nth", nth)
    body = _cells(orders, "o_custkey", F.col("nth"), [F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.concat(F.lit("Hotel "), "o_orderkey"), F.col("o_orderkey") % 9 + 1, F.concat(F.lit("TG-"), "o_orderkey"), F.col("o_orderkey") * 3, F.concat(F.lit("note "), "o_orderkey")])
    who = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    head = lambda names, test: _cells(who.where(test), "o_custkey", F.lit(0), [F.lit(n) for n in names])
    cells = head(_NORTH, "o_custkey % 3 = 0").unionByName(head(_OPEN, "o_custkey % 3 <> 0")).unionByName(body)
    mark = F.when(F.col("o_custkey") % 3 == 0, "From the North Desk").when(F.col("o_custkey") % 3 == 1, "south desk").otherwise("nobody")
    return cells, who.select(F.col("o_custkey").alias("doc_id"), mark.alias("text"))


_MIXED_ROWS = """SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_idx, strftime(o_orderdate, '%Y-%m-%d') AS "Date", 'Hotel ' || o_orderkey AS Hotel, CAST(o_orderkey % 9 + 1 AS INT) AS Adult,
'TG-' || o_orderkey AS "V.NO", CAST(o_orderkey * 3 AS DOUBLE) AS Total, CASE WHEN o_custkey % 3 = 0 THEN 'Memo: note ' ELSE 'Room: note ' END || o_orderkey AS Notes, CASE WHEN o_custkey % 3 = 0 THEN 'profile' ELSE 'dynamic' END AS strategy FROM orders"""


@query(_MIXED_ROWS)
def mixed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch: known suppliers by their profile, others, and those whose headers don't fit it, by fuzzy mapping."""
    cells, texts = _mixed(spark, sf_dir)
    found, _ = pipelines.transactions(cells, texts, Rules.of(_RULES), 2026, fix_arabic=False)
    return found.select("doc_id", "row_idx", "Date", "Hotel", "Adult", "`V.NO`", "Total", "Notes", "strategy")


@query(f"SELECT * EXCLUDE (strategy) FROM ({_MIXED_ROWS}) WHERE doc_id % 3 = 0")
def profile_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, texts = _mixed(spark, sf_dir)
    known = texts.where("doc_id % 3 = 0").select("doc_id", F.lit("north").alias("supplier"))
    found = pipelines.extract(cells.join(known.select("doc_id"), "doc_id", "left_semi"), fix_arabic=False)
    return pipelines.format_profile(found, known, Rules.of(_RULES), 2026).select("doc_id", "row_idx", "Date", "Hotel", "Adult", "`V.NO`", "Total", "Notes")


#: Headers a little off the profile's, and what each is taken for; a second header of a claimed column, and one like nothing, are left.
_NEAR = [("Arival", "Date", None), ("RESORT", "Hotel", None), ("Grown-ups", "Adult", None), ("Grownup", None, None), ("Tickets", "V.NO", None), ("Sum", "Total", None), ("Sums", None, None), ("Remarks", None, "Memo"), ("Zorblax", None, None)]


@query(f"SELECT n_nationkey AS doc_id, header, standard_column, note_label FROM nation, (VALUES {_values([r for r in _NEAR if r[1] or r[2]])}) v(header, standard_column, note_label)")
def fuzzy_profile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile columns claimed by inexact headers: the closest free one, in the profile's order."""
    heads = _headers(spark, sf_dir, [h for h, _, _ in _NEAR]).withColumn("supplier", F.lit("north"))
    return mapping.map_profile(heads, Rules.of(_RULES)).select("doc_id", "header", "standard_column", "note_label")


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Unknown (Smart Fallback)' WHEN 1 THEN 'Unknown (Smart Fallback)' ELSE 'north (profile)' END AS label FROM supplier")
def supplier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.when(F.col("s_suppkey") % 3 == 1, "auto_detected").when(F.col("s_suppkey") % 3 == 2, "north")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", mapping.supplier_label(key).alias("label"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'text' ELSE CASE WHEN page_id % 2 = 0 THEN 'ocr' ELSE 'text' END END AS engine FROM pages")
def engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was asked for, or for auto what the text needs: every second page has too little of it."""
    asked = F.when(F.col("page_id") % 3 == 0, "ocr").when(F.col("page_id") % 3 == 1, "text").otherwise("auto")
    text = F.when(F.col("page_id") % 2 == 0, "short").otherwise(F.repeat(F.lit("words "), F.lit(20)))
    return _t(spark, sf_dir, "pages").select("page_id", mapping.choose_engine(asked, S.needs_ocr(text, F.lit(1)))["value"].alias("engine"))


# Around them


@query("""SELECT o_orderkey AS "V.NO", CAST(o_totalprice AS DOUBLE) AS Total, NULL::VARCHAR AS Hotel, 'auto' AS Date FROM orders""")
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the columns asked for: known ones in order, a constant, and nulls for the one that is missing."""
    orders = _t(spark, sf_dir, "orders").select("o_orderstatus", F.col("o_totalprice").alias("Total"), F.col("o_orderkey").alias("V.NO"))
    return standardize.reindex(orders, ["V.NO", "Total", "Hotel", "Date"], {"Date": F.lit("auto")})


@query("SELECT l_orderkey AS doc_id, string_agg('Page ' || l_linenumber || ' (cid:3)end', chr(10) ORDER BY l_linenumber) AS text, count(*) AS pages FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1")
def raw_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of the first two pages with its glyph marks."""
    pages = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page"), F.concat(F.lit("Page "), "l_linenumber", F.lit(" (cid:3)end")).alias("text"))
    return readers.page_text(readers.first_pages(pages, 2), strip=False)


@query("""SELECT page_id, 'data:' || CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE 'application/pdf' END || ';base64,' || to_base64(encode(url)) AS url, page_id % 4 < 3 AS image FROM pages""")
def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four kinds as data URLs, and which of them are images."""
    kind: Column = F.element_at(F.array(*map(F.lit, ("a.JPG", "b.png", "c.x.jpeg", "d.PDF"))), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.replace(readers.image_url(F.encode("url", "UTF-8"), kind), F.lit("\r\n"), F.lit(""))
    return _t(spark, sf_dir, "pages").select("page_id", url.alias("url"), S.is_image(kind).alias("image"))


_NUMERIC = [("Total Cost", True), ("Adults", True), ("Hotel Name", False), ("Notes", False), ("EGP", True), ("", False), ("$", True), ("Child", True)]


@query(f"SELECT r_regionkey, header, is_number FROM region, (VALUES {_values(_NUMERIC)}) v(header, is_number)")
def numeric_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _t(spark, sf_dir, "region").select("r_regionkey", F.explode(F.array(*[F.lit(h) for h, _ in _NUMERIC])).alias("header"))
    return heads.select("*", S.is_numeric_header("header").alias("is_number"))


#: Equal words, a common start, containment, a shared word of the shorter text, matching blocks alone.
_ALIKE = [("hotel", "hotel", 1.0), ("dat", "date", 0.857143), ("ab", "xxabyy", 0.7), ("net", "net total", 1.0), ("room no", "no smoking", 0.5), ("", "date", 0.0), ("qqq", "zzz", 0.0)]


@query(f"SELECT r_regionkey, a, b, CAST(score AS DOUBLE) AS score FROM region, (VALUES {_values(_ALIKE)}) v(a, b, score)")
def loose_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in _ALIKE]))
    each = _t(spark, sf_dir, "region").select("r_regionkey", pairs.alias("p")).select("r_regionkey", "p.*")
    return each.withColumn("score", F.round(similarity_of(F.col("a"), F.col("b"), label_similarity), 6))


@query("""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS INT) AS row_idx, 'Hotel ' || o_orderkey AS "Hotel Name", CAST(o_orderkey * 3 AS VARCHAR) AS "Total", CAST(o_orderkey % 9 AS VARCHAR) AS "Adults" FROM orders""")
def second_header_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers whose second row names a column that the first leaves blank and adds to another."""
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = _t(spark, sf_dir, "orders").withColumn("nth", nth)
    who = orders.select("o_custkey").distinct()
    body = _cells(orders, "o_custkey", F.col("nth") + 1, [F.concat(F.lit("Hotel "), "o_orderkey"), F.col("o_orderkey") * 3, F.col("o_orderkey") % 9, F.lit("7")])
    cells = _cells(who, "o_custkey", F.lit(0), [F.lit("Hotel"), F.lit("Total"), F.lit(""), F.lit("Room")]).unionByName(_cells(who, "o_custkey", F.lit(1), [F.lit("Name"), F.lit(""), F.lit("Adults"), F.lit("")])).unionByName(body)
    headers, rows = tables.to_frames(cells, fix_arabic=False)
    named = rows.join(headers, ["doc_id", "table_id", "col_idx"]).where("header <> 'Room'")
    return named.groupBy("doc_id", "row_idx").pivot("header", ["Hotel Name", "Total", "Adults"]).agg(F.first("cell"))
