"""Grids of cells: header rows, summary blocks, metadata strips, value clean-up.

A grid is long: ``cells(doc_id, table_id, row_idx, col_idx, cell)``; every operator works on all grids at once, keyed by
(doc_id, table_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S

TABLE = ("doc_id", "table_id")
ROW = (*TABLE, "row_idx")
#: A name's stem and the number behind it, as repeats are numbered.
NUMBERED = r"(?s)\A(.+)_([1-9][0-9]{0,17})\z"


def clean_cells(cells: DataFrame) -> DataFrame:
    return cells.withColumn("cell", S.clean_cell("cell"))


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def header_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, header_idx): the fullest row that is half full and mostly words, else the fullest; the first in a tie."""
    rows = cells.groupBy(*ROW).agg(_count(F.col("cell") != "").alias("filled"), _count(F.col("cell").rlike(r"\p{L}")).alias("wordy"), F.max("col_idx").alias("last"))
    wide = F.max("last").over(W.partitionBy(*TABLE)) + 1
    fit = (F.col("filled") >= F.greatest(F.lit(2), F.floor(wide / 2))) & (F.col("wordy") >= F.floor(F.col("filled") / 2))
    best = W.partitionBy(*TABLE).orderBy(F.col("fit").desc(), F.col("filled").desc(), "row_idx")
    return rows.withColumn("fit", fit).withColumn("n", F.row_number().over(best)).where("n = 1").select(*TABLE, F.col("row_idx").alias("header_idx"))


def dedupe_headers(headers: DataFrame, keys: tuple[str, ...] = TABLE) -> DataFrame:
    """``headers`` (keys, col_idx, header) with blank names filled and repeats numbered; a numbered name never meets another.

    The n-th repeat of a name gets the number n, or the next that no other column of the table bears.
    """
    filled = headers.withColumn("header", F.when(F.coalesce("header", F.lit("")) == "", F.concat(F.lit("Unnamed_"), "col_idx")).otherwise(F.col("header")))
    # Names numbered from different stems never meet, so a stem's repeats get the numbers that no column bears, in order: one
    # exchange by stem, to which a column brings itself and, if its name is a numbered one, the number it takes from its stem.
    taken = F.regexp_extract("header", NUMBERED, 2).try_cast("bigint")
    own = F.struct(F.col("header").alias("stem"), F.lit(None).cast("bigint").alias("taken"))
    other = F.struct(F.regexp_extract("header", NUMBERED, 1).alias("stem"), taken.alias("taken"))
    each = filled.select(F.struct(*headers.columns).alias("row"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "col_idx", F.inline(F.when(taken.isNull(), F.array(own)).otherwise(F.array(own, other))))
    stem = [*[f"k{i}" for i in range(len(keys))], "stem"]
    each = each.repartition(*stem)  # by its own keys the first window would ask for another exchange
    by = W.partitionBy(*stem, F.col("taken").isNull()).orderBy("taken", "col_idx")
    each = each.withColumns({"nth": F.row_number().over(by) - 1, "rank": F.dense_rank().over(W.partitionBy(*stem, F.col("taken").isNull()).orderBy("taken")), "first": F.coalesce(F.lag("taken").over(by) != F.col("taken"), F.col("taken").isNotNull())})
    # The j-th number taken, r, moves the repeats from r - j + 1 on by one.
    at = F.coalesce(F.col("taken") - F.col("rank") + 1, F.col("nth"))
    moved = F.count_if("first").over(W.partitionBy(*stem).orderBy(at, F.col("taken").isNull()).rowsBetween(W.unboundedPreceding, 0))
    each = each.withColumn("moved", moved).where("taken is null")
    name = F.when(F.col("nth") == 0, F.col("stem")).otherwise(F.concat_ws("_", "stem", F.col("nth") + F.col("moved")))
    return each.select(*[(name if c == "header" else F.col("row")[c]).alias(c) for c in headers.columns])


def in_reading_order(cell: str, fix_arabic: bool | str) -> Column:
    """A cell with Arabic put in reading order if ``fix_arabic``; as a name, where that column is true. Null becomes empty."""
    plain = F.coalesce(F.col(cell), F.lit(""))
    if isinstance(fix_arabic, str):
        return F.when(F.col(fix_arabic), S.fix_arabic(cell)).otherwise(plain)
    return S.fix_arabic(cell) if fix_arabic else plain


def to_frames(cells: DataFrame, fix_arabic: bool | str = True) -> tuple[DataFrame, DataFrame]:
    """(headers(doc_id, table_id, col_idx, header), body cells) of clean ``cells``.

    A sparser row below the header that fills one of its gaps, and holds no digits, is a second header row.
    """
    fix = lambda c: in_reading_order(c, fix_arabic)
    placed = cells.join(header_rows(cells), list(TABLE))
    pair = placed.where("row_idx in (header_idx, header_idx + 1)").groupBy(*TABLE, "col_idx").agg(F.coalesce(F.max(F.when(F.col("row_idx") == F.col("header_idx"), fix("cell"))), F.lit("")).alias("top"), F.coalesce(F.max(F.when(F.col("row_idx") > F.col("header_idx"), fix("cell"))), F.lit("")).alias("below"))
    whole = W.partitionBy(*TABLE)
    n_top, n_below = F.count_if(F.col("top") != "").over(whole), F.count_if(F.col("below") != "").over(whole)
    gap = F.count_if((F.col("below") != "") & (F.col("top") == "")).over(whole) > 0
    digits = F.count_if(F.col("below").rlike(r"\p{Nd}")).over(whole) > 0
    pair = pair.withColumn("second", (n_below > 0) & (n_below < n_top) & gap & ~digits)
    named = F.when(F.col("second"), F.trim(F.concat_ws(" ", F.nullif("top", F.lit("")), F.nullif("below", F.lit(""))))).otherwise(F.col("top"))
    headers = dedupe_headers(pair.select(*TABLE, "col_idx", named.alias("header")))
    skip = pair.groupBy(*TABLE).agg(F.max("second").alias("second"))
    body = placed.join(skip, list(TABLE)).where(F.col("row_idx") > F.col("header_idx") + F.col("second").cast("int")).drop("header_idx", "second")
    return headers, body


def _judged(body: DataFrame, headers: DataFrame, arabic_labels: bool, min_filled: int | None) -> DataFrame:
    """``body`` with __summary (boolean), all of it by windows inside the tables: one exchange by table, which headers share."""
    names = headers.select(*TABLE, "col_idx", F.lower(F.trim("header")).alias("__name"), F.lit(True).alias("__head"))
    both = body.withColumn("__head", F.lit(False)).unionByName(names, allowMissingColumns=True).repartition(*TABLE)
    whole = W.partitionBy(*TABLE)
    t = F.trim(F.coalesce("cell", F.lit("")))
    low = F.lower(t)
    lead = ~F.col("__head") & (F.col("col_idx") == F.col("__first"))
    is_lead = lead & (low.isin(*K.TOTAL_LABELS) | F.array_contains("__names", low) | low.isin(*K.SUMMARY_WORDS) | low.startswith("t.cost") | low.startswith("t cost"))
    if arabic_labels:
        is_lead = is_lead | (lead & S.has_arabic(t))
    labelled = t.rlike(K.SUMMARY_CELL) | t.rlike(K.SUMMARY_ROW) | t.rlike(K.INVOICE_LABEL)
    # Columns first: their order serves the tables too.
    marked = both.withColumn("__names", F.collect_set("__name").over(W.partitionBy(*TABLE, "col_idx")))
    marked = marked.withColumns({"__first": F.min(F.when(~F.col("__head"), F.col("col_idx"))).over(whole), "__width": F.count_if("__head").over(whole)})
    marked = marked.where(~F.col("__head")).withColumns({"__label": F.coalesce(is_lead, F.lit(False)) | labelled, "__full": t != ""})
    least = F.lit(min_filled)
    if min_filled is None:
        # A table without headers has no width, and keeps its rows.
        least = F.when(F.col("__width") > 0, F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("__width") / 2))))
    row = W.partitionBy(*ROW)
    summary = F.max("__label").over(row) | (F.count_if("__full").over(row) < least)
    if min_filled is None:
        summary = summary & (F.col("__width") > 0)
    return marked.withColumn("__summary", F.coalesce(summary, F.lit(False))).select(*body.columns, "__summary")


def summary_rows(body: DataFrame, headers: DataFrame, arabic_labels: bool = True, min_filled: int | None = 5) -> DataFrame:
    """(doc_id, table_id, row_idx) of rows that are totals, repeated headers, labels or nearly empty.

    ``min_filled`` None scales with the table: half its columns, 2 at least and 5 at most.
    """
    return _judged(body, headers, arabic_labels, min_filled).where("__summary").select(*ROW).distinct()


def drop_summary_rows(body: DataFrame, headers: DataFrame, arabic_labels: bool = True, min_filled: int | None = 5) -> DataFrame:
    """``body`` without ``summary_rows``; rows whose place is null stay."""
    nowhere = F.col("doc_id").isNull() | F.col("table_id").isNull() | F.col("row_idx").isNull()
    return _judged(body, headers, arabic_labels, min_filled).where(~F.col("__summary") | nowhere).drop("__summary")


def summary_tables(cells: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, table_id) of summary blocks: two columns under a summary label, or summary words in half the first column.

    ``strict`` asks for more than half, which spares a table of one data row and a total.
    """
    wide = F.max("col_idx").over(W.partitionBy(*TABLE)) + 1
    first = cells.withColumn("wide", wide).where("col_idx = 0")
    word = F.lower("cell").isin(*K.SUMMARY_WORDS)
    seen = first.groupBy(*TABLE).agg(F.max("wide").alias("wide"), F.min_by("cell", "row_idx").alias("top"), _count(F.col("cell") != "").alias("labels"), _count(word).alias("hits"))
    enough = F.col("hits") * 2 > F.col("labels") if strict else F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("labels") / 2))
    return seen.where(((F.col("wide") == 2) & F.col("top").rlike(K.SUMMARY_LABEL)) | ((F.col("labels") > 0) & enough)).select(*TABLE)


def summary_values(cells: DataFrame) -> DataFrame:
    """(doc_id, label, value_num, value_text) of summary blocks; the last row of a label counts, a missing value is null."""
    pair = cells.where("col_idx < 2").groupBy(*ROW).agg(F.max(F.when(F.col("col_idx") == 0, F.col("cell"))).alias("label"), F.max(F.when(F.col("col_idx") == 1, F.col("cell"))).alias("value"))
    last = W.partitionBy("doc_id", "label").orderBy(F.col("table_id").desc(), F.col("row_idx").desc())
    pair = pair.where("label <> ''").withColumn("n", F.row_number().over(last)).where("n = 1").withColumn("money", S.parse_money("value"))
    return pair.select("doc_id", "label", F.col("money.num").alias("value_num"), F.col("money.txt").alias("value_text"))


def split_metadata(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells without metadata strips, (doc_id, label, value_num, value_text) of the strips).

    A strip is a row with two or more invoice labels and the row of values under it; a label's first value counts.
    """
    label_rows = cells.groupBy(*ROW).agg(_count(F.col("cell").rlike(K.INVOICE_LABEL)).alias("n")).where("n >= 2").select(*ROW)
    value_rows = label_rows.withColumn("row_idx", F.col("row_idx") + 1)
    kept = cells.join(label_rows.unionByName(value_rows).distinct(), list(ROW), "left_anti")
    labels = cells.join(label_rows, list(ROW), "left_semi").where("cell <> ''").select(*TABLE, "row_idx", "col_idx", F.col("cell").alias("label"))
    values = cells.select(*TABLE, (F.col("row_idx") - 1).alias("row_idx"), "col_idx", F.col("cell").alias("value"))
    first = W.partitionBy("doc_id", "label").orderBy("table_id", "row_idx", "col_idx")
    pairs = labels.join(values, [*ROW, "col_idx"]).where("value <> ''").withColumn("n", F.row_number().over(first)).where("n = 1").withColumn("money", S.parse_money("value"))
    return kept, pairs.select("doc_id", "label", F.col("money.num").alias("value_num"), F.col("money.txt").alias("value_text"))


def clean_values(body: DataFrame, headers: DataFrame, fix_arabic: bool | str = True) -> DataFrame:
    """``body`` with Arabic put in reading order and the cells of money columns parsed (as text again)."""
    named = body.join(headers, [*TABLE, "col_idx"])
    named = named.withColumn("cell", in_reading_order("cell", fix_arabic))
    return named.withColumn("cell", F.when(S.is_money_header("header"), S.money_text("cell")).otherwise(F.col("cell")))
