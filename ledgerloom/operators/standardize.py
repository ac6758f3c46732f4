"""From mapped cells to the standard schema: one row a transaction, fixed columns and types."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S


def typed(name: str, value: Column, year_now: int) -> Column:
    """A standard column's value from its cell's text: amounts as double, counts as integer, dates as text, else text."""
    if name in K.MONEY_COLUMNS:
        return S.to_number(value)
    if name in K.COUNT_COLUMNS:
        return S.to_count(value)
    if name == "Date":
        return S.parse_date(value, year_now)
    return value


def standardize(cells: DataFrame, mapped: DataFrame, year_now: int, columns: Iterable[str] = K.STANDARD_COLUMNS) -> DataFrame:
    """One row for each body row of ``cells`` with exactly ``columns`` after doc_id, table_id and row_idx.

    ``mapped`` tells for (doc_id, table_id, col_idx) the standard_column or the note_label. Columns without a source are
    null (counts 0, notes empty); notes join ``label: value`` in column order.
    """
    named = cells.join(mapped.select("doc_id", "table_id", "col_idx", "standard_column", "note_label"), ["doc_id", "table_id", "col_idx"], "left")
    pick = lambda c: F.min_by(F.when(F.col("standard_column") == c, F.col("cell")), F.when(F.col("standard_column") == c, F.col("col_idx")))
    value = F.trim("cell")
    note = F.when(F.col("note_label").isNotNull() & ~value.isin(*K.BLANK_MARKS), F.struct("col_idx", F.concat_ws(": ", F.nullif("note_label", F.lit("")), value).alias("text")))
    gathered = named.groupBy("doc_id", "table_id", "row_idx").agg(*[pick(c).alias(f"v{i}") for i, c in enumerate(columns) if c != "Notes"], F.array_sort(F.collect_list(note)).alias("notes"))
    out = [F.array_join(F.col("notes.text"), " | ").alias(c) if c == "Notes" else typed(c, F.col(f"v{i}"), year_now).alias(c) for i, c in enumerate(columns)]
    return gathered.select("doc_id", "table_id", "row_idx", *out)


def standardize_dynamic(cells: DataFrame, mapped: DataFrame, year_now: int) -> DataFrame:
    """``standardize`` with headers that no column claimed kept as notes under their own names."""
    return standardize(cells, mapped.withColumn("note_label", F.when(F.col("standard_column").isNull(), F.col("header"))), year_now)


def reindex(df: DataFrame, columns: Iterable[str] = K.STANDARD_COLUMNS, constants: dict[str, Column] | None = None) -> DataFrame:
    """Exactly ``columns`` in order; missing ones are null or their constant."""
    fill = constants or {}
    quoted = lambda c: F.col(f"`{c}`")
    return df.select(*[(fill[c] if c in fill else quoted(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in columns])


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
