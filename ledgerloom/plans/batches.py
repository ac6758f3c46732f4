"""Queries over whole batches: layouts by each document's supplier, routed runs, errors as rows, many identifiers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import geometry, matching
from ledgerloom.plans import batch, pipelines
from ledgerloom.plans.queries import _cells, _page, _t, query
from ledgerloom.plans.routes import _values
from ledgerloom.sources import files, readers
from ledgerloom.sources.rules import Rules, rule_tables
from ledgerloom.sources.store import new_folder

_LEFT = (10, 200, 450, 700)
_USUAL = ("Date", "Hotel", "Adult", "Total")


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", nth.alias("nth"))


def _boxes(lines: DataFrame) -> DataFrame:
    """Pages from lines (o_custkey, line, values): a box for each value that isn't null, columns at fixed places."""
    each = lines.select("o_custkey", "line", F.posexplode("values").alias("col", "text")).where("text is not null")
    left = F.array(*map(F.lit, _LEFT))[F.col("col")]
    return _page(each, F.col("o_custkey"), F.col("line") * 4 + F.col("col"), F.col("text"), left, F.col("line") * 30, left + 120, F.col("line") * 30 + 20, 900.0)


def _texts(*names: str | None) -> Column:
    return F.array(*[F.lit(n).cast("string") for n in names])


# Layouts

_LAYOUTS = {"alpha": ("Arrival", "Resort", "Grownups", "Sum"), "beta": ("Day", "Place", "Heads", "Amount"), "gamma": ("Check In", "Lodging", "Persons", "Price")}
_LAYOUT_RULES = {"suppliers": {k: {"identifiers": [k], "columns_mapping": dict(zip(names, _USUAL, strict=True))} for k, names in _LAYOUTS.items()}}
_HEADS = [*_LAYOUTS.values(), _USUAL]


@query(f"""WITH r AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_idx FROM orders)
SELECT doc_id, row_idx, band AS col_idx, CASE band WHEN 0 THEN strftime(o_orderdate, '%-d-%b-%Y') WHEN 1 THEN 'Hotel ' || o_orderkey WHEN 2 THEN CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 9 + 1 AS VARCHAR) ELSE '' END ELSE CAST(o_orderkey * 3 AS VARCHAR) END AS cell
FROM r, (SELECT CAST(unnest(range(4)) AS INT) AS band)
UNION ALL SELECT doc_id, 0, col_idx, header FROM (SELECT DISTINCT doc_id FROM r) JOIN (VALUES {_values([(k, i, h) for k, heads in enumerate(_HEADS) for i, h in enumerate(heads)])}) v(kind, col_idx, header) ON doc_id % 4 = kind""")
def layouts_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three suppliers, each cut by its own header, and of none, in one batch; above its header a page shows another supplier's."""
    kind, orders = F.col("o_custkey") % 4, _numbered(spark, sf_dir)
    heads = F.element_at(F.array(*[_texts(*h) for h in _HEADS]), (kind + 1).cast("int"))
    decoy = F.when(kind < 3, F.element_at(F.array(*[_texts(*_HEADS[(i + 1) % 3]) for i in range(4)]), (kind + 1).cast("int")))
    who = orders.where("nth = 1")
    values = F.array(F.date_format(F.col("o_orderdate").cast("date"), "d-MMM-yyyy"), F.concat(F.lit("Hotel "), "o_orderkey"), F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 9 + 1).cast("string")), (F.col("o_orderkey") * 3).cast("string"))
    lines = who.select("o_custkey", F.lit(0).alias("line"), decoy.alias("values")).where("values is not null").unionByName(who.select("o_custkey", F.lit(3).alias("line"), heads.alias("values"))).unionByName(orders.select("o_custkey", (F.col("nth") + 3).alias("line"), values.alias("values")))
    suppliers = who.where(kind < 3).select(F.col("o_custkey").alias("doc_id"), F.element_at(_texts(*_LAYOUTS), (kind + 1).cast("int")).alias("supplier"))
    labels = rule_tables(spark, Rules.of(_LAYOUT_RULES))["supplier_labels"]
    return pipelines.recognised_cells(_boxes(lines), labels, suppliers).select("doc_id", "row_idx", "col_idx", "cell")


# Routed runs

_RUN_RULES = {
    "standard_columns": ["Date", "Hotel", "Adult", "V.NO", "Total", "Notes"],
    "suppliers": {
        "north": {"identifiers": ["north desk"], "columns_mapping": {"Arrival": "Date", "Resort": "Hotel", "Grownups": "Adult", "Sum": "Total"}},
        "east": {"identifiers": ["east desk", "east office"], "columns_mapping": {"Day": "Date", "Place": "Hotel", "Heads": "Adult", "Amount": "Total"}},
    },
}
_NORTH, _EAST = ("Arrival", "Resort", "Grownups", "Sum"), ("Day", "Place", "Heads", "Amount")


def _one_of(*values: Column | str | None) -> Column:
    """The value for a document's kind."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v).cast("string") for v in values]), (F.col("o_custkey") % 7 + 1).cast("int"))


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(docs, cells, boxes) by customer, of seven kinds: north's and nobody's text, north's scan, a picture forced to east, a scan of nobody, an unknown engine, an unknown file type."""
    orders = _numbered(spark, sf_dir)
    who = orders.where("nth = 1")
    long = lambda t: F.repeat(F.lit(f"{t} "), F.lit(30))
    forced = F.when((F.col("o_custkey") % 7 == 1) & (F.col("o_custkey") % 2 == 0), batch.DYNAMIC).when(F.col("o_custkey") % 7 == 3, "east")
    docs = who.select(
        F.col("o_custkey").alias("doc_id"), _one_of("a.pdf", "b.PDF", "c.pdf", "d.JPG", "e.pdf", "f.pdf", "g.docx").alias("name"), _one_of("auto", "text", None, "magic", "ocr", "magic", "auto").alias("engine"),
        forced.alias("supplier"), _one_of(long("The North Desk"), F.when(F.col("o_custkey") % 2 == 0, long("The North Desk")).otherwise(long("Somebody")), "x", "", long("Somebody"), long("North Desk"), "").alias("text"), F.lit(1).alias("pages"),
    )
    values = [F.date_format(F.col("o_orderdate").cast("date"), "d-MMM-yyyy"), F.concat(F.lit("Hotel "), "o_orderkey"), (F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_orderkey") * 3).cast("string")]
    heads = F.element_at(F.array(*[_texts(*h) for h in (_NORTH, _USUAL, _NORTH, _EAST, _USUAL, _USUAL, _USUAL)]), (F.col("o_custkey") % 7 + 1).cast("int"))
    lines = who.select("o_custkey", F.lit(2).alias("line"), heads.alias("values")).unionByName(orders.select("o_custkey", (F.col("nth") + 2).alias("line"), F.array(*values).alias("values")))
    top = who.where("o_custkey % 7 = 2").select("o_custkey", F.lit(0).alias("line"), _texts("From the North Desk").alias("values"))
    grid = lines.where("o_custkey % 7 in (0, 1, 5, 6)")
    cells = grid.select(F.col("o_custkey").alias("doc_id"), F.lit(0).alias("table_id"), (F.col("line") - 2).cast("int").alias("row_idx"), F.posexplode("values").alias("col_idx", "cell"))
    return docs, cells, _boxes(lines.where("o_custkey % 7 in (2, 3, 4, 5)").unionByName(top))


@query("""SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS row_idx, strftime(o_orderdate, '%Y-%m-%d') AS "Date", 'Hotel ' || o_orderkey AS Hotel, CAST(o_orderkey % 9 + 1 AS INT) AS Adult, CAST(o_orderkey * 3 AS DOUBLE) AS Total,
CASE o_custkey % 7 WHEN 0 THEN 'north' WHEN 2 THEN 'north' WHEN 3 THEN 'east' ELSE 'auto_detected' END AS supplier FROM orders WHERE o_custkey % 7 < 5""")
def routed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, scans and pictures, known and forced suppliers and unknown ones, in one plan."""
    docs, cells, boxes = _batch(spark, sf_dir)
    found = batch.run(docs, cells, boxes, Rules.of(_RUN_RULES), 2026).transactions
    return found.select("doc_id", "row_idx", "Date", "Hotel", "Adult", "Total", "supplier")


@query("""SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 7 < 2 THEN 'text' WHEN o_custkey % 7 < 5 THEN 'ocr' END AS route, CASE o_custkey % 7 WHEN 0 THEN 'north' WHEN 1 THEN 'auto_detected' WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN 'east' END WHEN 4 THEN CASE WHEN o_custkey % 3 > 0 THEN 'auto_detected' END END AS supplier,
CASE WHEN o_custkey % 7 < 2 OR (o_custkey % 7 = 3 AND o_custkey % 2 = 0) OR (o_custkey % 7 = 4 AND o_custkey % 3 > 0) THEN count(*) ELSE 0 END AS n_rows,
CASE o_custkey % 7 WHEN 2 THEN 'payload is not JSON' WHEN 3 THEN CASE WHEN o_custkey % 2 = 1 THEN 'no table found' END WHEN 4 THEN CASE WHEN o_custkey % 3 = 0 THEN 'payload has no lines' END WHEN 5 THEN 'unknown engine: magic' WHEN 6 THEN 'unsupported file type: g.docx' END AS error
FROM orders GROUP BY 1""")
def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each document: unreadable answers, blank pages, unknown engines and file types stand beside the good ones."""
    docs, cells, boxes = _batch(spark, sf_dir)
    # Scans arrive as recognizer answers: some cut off, some of another shape, some without lines.
    said = F.collect_list(F.struct("text", "x0", "y0", "x1", "y1"))
    line = lambda b: F.concat(F.lit('[[['), b["x0"], F.lit(","), b["y0"], F.lit("],["), b["x1"], F.lit(","), b["y1"], F.lit(']],["'), b["text"], F.lit('",0.9]]'))
    answer = F.concat(F.lit("["), F.array_join(F.transform("said", line), ","), F.lit("]"))
    kind = F.col("doc_id") % 7
    payload = F.when(kind == 2, '[[[0,0],["cut').when((kind == 3) & (F.col("doc_id") % 2 == 1), "[]").when((kind == 4) & (F.col("doc_id") % 3 == 0), '{"other":1}').otherwise(answer)
    payloads = boxes.groupBy("doc_id", "page").agg(said.alias("said")).select("doc_id", "page", payload.alias("payload"))
    found = batch.run(docs, cells, readers.decode_payloads(payloads), Rules.of(_RUN_RULES), 2026, readers.payload_errors(payloads))
    return found.results


@query("""WITH marks AS (SELECT p_partkey % 50 AS owner, 'desk ' || p_partkey AS mark FROM part UNION ALL SELECT p_partkey % 50, 'copy ' || p_partkey % 7 FROM part WHERE p_partkey < 60),
texts AS (SELECT c_custkey AS doc_id, 'from desk ' || c_custkey || ', copy ' || c_custkey % 11 || ' to desk ' || c_custkey * 7 % 500 AS t FROM customer),
hits AS (SELECT doc_id, owner, count(*) AS n FROM texts JOIN marks ON contains(t, mark) GROUP BY 1, 2),
best AS (SELECT doc_id, owner, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, owner) AS k FROM hits)
SELECT doc_id, 's' || owner AS supplier FROM best WHERE k = 1""")
def detect_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by as many identifiers as there are parts; identifiers hold each other, are shared and are listed twice."""
    part, customer = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "customer")
    owner = (F.col("p_partkey") % 50).alias("decl_order")
    marks = part.select(owner, F.concat(F.lit("Desk "), "p_partkey").alias("identifier")).unionByName(part.where("p_partkey < 60").select(owner, F.concat(F.lit("COPY "), F.col("p_partkey") % 7).alias("identifier")))
    texts = customer.select(F.col("c_custkey").alias("doc_id"), F.concat(F.lit("From DESK "), "c_custkey", F.lit(", Copy "), F.col("c_custkey") % 11, F.lit(" to desk "), F.col("c_custkey") * 7 % 500).alias("text"))
    return matching.detect_suppliers(texts, marks.withColumn("supplier", F.concat(F.lit("s"), "decl_order")))


# Files


@query("""WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 'Hotel, "' || o_orderkey || '"' AS hotel, o_orderkey % 100 AS egp, o_orderkey % 7 AS usd FROM orders)
SELECT o_custkey || '.csv' AS file, CAST(n AS BIGINT) AS line, hotel AS "Hotel", CAST(egp AS DOUBLE) AS "EGP", CAST(usd AS DOUBLE) AS "USD", CAST(egp + usd * 50 AS DOUBLE) AS "EGP Converter" FROM r
UNION ALL SELECT o_custkey || '.csv', count(*) + 1, 'TOTAL', CAST(sum(egp) AS DOUBLE), CAST(sum(usd) AS DOUBLE), CAST(sum(egp + usd * 50) AS DOUBLE) FROM r GROUP BY o_custkey""")
def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, written by parallel tasks and read back: rows in order, EGP amounts, the subtotal last."""
    orders = _numbered(spark, sf_dir)
    hotel = F.concat(F.lit('Hotel, "'), "o_orderkey", F.lit('"'))
    rows = orders.select(F.col("o_custkey").alias("doc_id"), F.col("nth").alias("row_idx"), hotel.alias("Hotel"), (F.col("o_orderkey") % 100).cast("double").alias("EGP"), (F.col("o_orderkey") % 7).cast("double").alias("USD"), F.lit(0.0).alias("Euros"), F.lit(0.0).alias("GBP"))
    folder = new_folder(spark, "exported")
    files.export_files(rows, folder, rates={"USD": 50.0, "Euros": 55.0, "GBP": 65.0})
    read = files.page_files(spark, folder, ".csv").select("doc_id", F.posexplode(F.split("content", "\n")).alias("line", "text")).where("line > 0 and text <> ''")
    cells = F.from_csv("text", "Hotel string, EGP double, USD double, Euros double, GBP double, c double", {"escape": '"'})
    return read.select(F.col("doc_id").alias("file"), F.col("line").cast("bigint").alias("line"), cells.alias("c")).select("file", "line", "c.Hotel", "c.EGP", "c.USD", F.col("c.c").alias("EGP Converter"))


# Pages that lie on their side


@query(f"""WITH r AS (SELECT o_custkey AS doc_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
each AS (SELECT doc_id, n + 2 AS line, col, CASE col WHEN 0 THEN '2024-01-0' || o_orderkey % 9 + 1 WHEN 1 THEN 'Hotel ' || o_orderkey WHEN 2 THEN 'x' || o_orderkey % 9 ELSE CAST(o_orderkey * 3 AS VARCHAR) END AS text FROM r, (SELECT unnest(range(4)) AS col)
  UNION ALL SELECT DISTINCT doc_id, 2, col, h FROM r, (VALUES {_values(list(enumerate(_USUAL)))}) v(col, h))
SELECT doc_id, CAST(line * 4 + col AS INT) AS box_id, text, CAST(l AS DOUBLE) AS x0, CAST(line * 30 AS DOUBLE) AS y0, CAST(l + 120 AS DOUBLE) AS x1, CAST(line * 30 + 20 AS DOUBLE) AS y1, CAST(900 AS DOUBLE) AS page_width,
CASE doc_id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'counterclockwise' ELSE 'clockwise' END AS turn FROM each JOIN (VALUES {_values(list(enumerate(_LEFT)))}) w(c, l) ON c = col""")
def upright_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of which two thirds were turned by a quarter, one way or the other, come back as they were."""
    orders = _numbered(spark, sf_dir)
    values = F.array(F.concat(F.lit("2024-01-0"), F.col("o_orderkey") % 9 + 1), F.concat(F.lit("Hotel "), "o_orderkey"), F.concat(F.lit("x"), F.col("o_orderkey") % 9), (F.col("o_orderkey") * 3).cast("string"))
    lines = orders.where("nth = 1").select("o_custkey", F.lit(2).alias("line"), _texts(*_USUAL).alias("values")).unionByName(orders.select("o_custkey", (F.col("nth") + 2).alias("line"), values.alias("values")))
    boxes, kind, height = _boxes(lines), F.col("doc_id") % 3, F.lit(3000.0)
    turned = geometry.rotate(boxes.where(kind == 1), height).unionByName(geometry.rotate(boxes.where(kind == 2), height, clockwise=False)).withColumn("height", F.lit(900.0))
    pages = boxes.where(kind == 0).withColumn("height", height).unionByName(turned)
    labels = spark.createDataFrame([("", n) for n in _USUAL], "supplier string, label string")
    return geometry.upright(pages, F.col("height"), labels).select("doc_id", "box_id", "text", "x0", "y0", "x1", "y1", "page_width", "turn")
