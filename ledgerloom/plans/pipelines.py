"""Whole ways from grids, boxes or replies to standard transactions. Each takes any number of documents at once and writes a table between steps that are read several times."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import geometry, mapping, matching, qa, rows, standardize, tables
from ledgerloom.sources.readers import parse_replies
from ledgerloom.sources.rules import Rules, rule_tables
from ledgerloom.sources.store import settle


@dataclass
class Extracted:
    """Raw transactions, a row a grid row with its cells as an array c, their headers, and the summary values found beside them."""

    headers: DataFrame
    rows: DataFrame
    summary: DataFrame

    @property
    def body(self) -> DataFrame:
        """The transactions in long form (doc_id, table_id, row_idx, col_idx, cell), cells of money columns parsed (as text again)."""
        each = self.rows.select(*tables.TABLE, "row_idx", F.posexplode("c").alias("col_idx", "cell"))
        return tables.clean_values(each, self.headers, fix_arabic=False).drop("header")


def extract(cells: DataFrame, fix_arabic: bool | str = True, arabic_labels: bool = False, min_filled: int | None = None, strict: bool = True, together: bool = False) -> Extracted:
    """Separates metadata strips and summary blocks from the transaction tables and cleans the values of the rest.

    ``fix_arabic`` may name a column of ``cells`` that tells it for each table. ``strict`` False also takes a table of one
    data row and a total for a summary block, and so loses its row. ``together`` as in ``rows.to_rows``.
    """
    keep = [fix_arabic] if isinstance(fix_arabic, str) else []
    found = settle(rows.classify(rows.to_rows(tables.clean_cells(cells), keep, together), fix_arabic, arabic_labels, min_filled, strict), "rows")
    values, strips = rows.block_values(found), rows.strip_values(found)
    # A block's value stands before a strip's of the same label.
    summary = values.unionByName(strips.join(values, ["doc_id", "label"], "left_anti"))
    return Extracted(settle(rows.headers_of(found), "headers"), found.where(F.col("role") == rows.DATA).select(*tables.TABLE, "row_idx", "c"), summary)


def as_notes(mapped: DataFrame) -> DataFrame:
    """``map_columns``'s result with headers that no column claimed as notes under their own names."""
    return mapped.withColumn("note_label", F.when(F.col("standard_column").isNull(), F.col("header")))


def format_dynamic(found: Extracted, year_now: int) -> DataFrame:
    """Standard transactions by fuzzy header mapping; what no column claims goes to the notes."""
    return rows.standardize_rows(found.rows, as_notes(mapping.map_columns(found.headers)), year_now)


def format_profile(found: Extracted, suppliers: DataFrame, rules: Rules, year_now: int) -> DataFrame:
    """Standard transactions by each document's supplier profile; ``suppliers`` has (doc_id, supplier)."""
    return rows.standardize_rows(found.rows, mapping.map_profile(found.headers.join(suppliers, "doc_id"), rules), year_now, rules.standard_columns)


def transactions(cells: DataFrame, texts: DataFrame, rules: Rules, year_now: int, fix_arabic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(transactions, summary) of a mixed batch: documents of a known supplier by its profile where their headers fit it, others by fuzzy mapping.

    ``texts`` has (doc_id, text). The choice is made by table in the plan, so a mixed batch goes through together.
    """
    found = extract(cells, fix_arabic)
    known = matching.detect_suppliers(texts, rule_tables(texts.sparkSession, rules)["supplier_identifiers"])
    mapped = settle(mapping.map_profile(found.headers.join(known, "doc_id"), rules), "mapped")
    fits = settle(mapping.profile_fits(mapped).where("fits").select(*tables.TABLE), "fits")
    by_profile = rows.standardize_rows(found.rows.join(fits, list(tables.TABLE), "left_semi"), mapped, year_now, rules.standard_columns)
    rest = Extracted(found.headers.join(fits, list(tables.TABLE), "left_anti"), found.rows.join(fits, list(tables.TABLE), "left_anti"), found.summary)
    both = by_profile.withColumn("strategy", F.lit("profile")).unionByName(format_dynamic(rest, year_now).withColumn("strategy", F.lit("dynamic")), allowMissingColumns=True)
    return both, found.summary


def recognised_cells(boxes: DataFrame, labels: Sequence[str] | DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """Grids of recognised pages: pages whose header resembles their layout are cut by its columns, others by their own.

    ``labels`` and ``suppliers`` as in ``geometry.template_cells``.
    """
    if labels is None:
        return geometry.boxes_to_cells(boxes)
    cells, _ = geometry.template_cells(boxes, labels, suppliers)
    cells = settle(cells, "template")
    other = boxes.join(cells.select("doc_id", F.col("table_id").alias("page")).distinct(), ["doc_id", "page"], "left_anti")
    return cells.unionByName(geometry.boxes_to_cells(other))


def boxes_to_transactions(boxes: DataFrame, year_now: int, labels: Sequence[str] | DataFrame | None = None, suppliers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(transactions, summary) of recognised pages, known layouts (``recognised_cells``) and unknown ones in one batch."""
    found = extract(recognised_cells(boxes, labels, suppliers), fix_arabic=False)
    return format_dynamic(found, year_now), found.summary


def box_text(boxes: DataFrame) -> DataFrame:
    """(doc_id, text): all boxes' texts in order, for supplier detection."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "box_id", "text"))), lambda b: b["text"]), "\n")
    return boxes.groupBy("doc_id").agg(joined.alias("text"))


def review_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, results with review) of JSON replies: good ones are checked against their footer, bad ones carry their error."""
    found, results = parse_replies(replies)
    checked = qa.review(found.select("doc_id", F.col("Total").alias("total"), F.col("Net").alias("net")), results.where("error is null").select("doc_id", "footer_total", "footer_net"))
    return found, results.join(checked, "doc_id", "left")


def reply_transactions(replied: DataFrame, year_now: int) -> DataFrame:
    """Reply rows with the standard columns and types, amounts converted to EGP."""
    types = {c: standardize.typed(c, F.col(f"`{c}`"), year_now) for c in replied.columns if c not in ("doc_id", "row_idx")}
    fixed = replied.select("doc_id", "row_idx", *[v.alias(c) for c, v in types.items()])
    filled = fixed.withColumn("EGP Converter", S.in_egp("EGP", "USD", "Euros", "GBP"))
    return standardize.reindex(filled, ["doc_id", "row_idx", *standardize.K.STANDARD_COLUMNS])
