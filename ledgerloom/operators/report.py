"""What goes out: conversion, subtotals, column widths, records, the newest of a cache."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S


def with_egp(df: DataFrame, rates: dict[str, float] | None = None, name: str = "EGP Converter") -> DataFrame:
    """Adds the amount in EGP of the four currency columns."""
    return df.withColumn(name, S.in_egp(F.col("EGP"), F.col("USD"), F.col("Euros"), F.col("GBP"), rates))


def label_column(columns: Sequence[str], kinds: dict[str, str]) -> str | None:
    """Where a subtotal's label goes: the first of the usual columns, else the first text column."""
    return next((c for c in K.LABEL_COLUMNS if c in columns), next((c for c in columns if kinds.get(c) == "string"), None))


def with_subtotal(df: DataFrame, label: str = "TOTAL", money: Iterable[str] = K.MONEY_COLUMNS) -> DataFrame:
    """``df`` and, unless it is empty, one row with the sums of its money columns under ``label``; is_total tells it apart."""
    kinds, place = dict(df.dtypes), label_column(df.columns, dict(df.dtypes))
    quoted = lambda c: F.col(f"`{c}`")
    summed = {c for c in money if c in df.columns}
    cells: list[Column] = [F.sum(quoted(c)).alias(c) if c in summed else F.first(F.lit(label if c == place else None).cast(kinds[c])).alias(c) for c in df.columns]
    total = df.agg(*cells, F.count(F.lit(1)).alias("__n")).where("__n > 0").drop("__n")
    return df.withColumn("is_total", F.lit(False)).unionByName(total.withColumn("is_total", F.lit(True)))


def with_subtotals(df: DataFrame, by: str, order: str, label: str = "TOTAL", money: Iterable[str] = K.MONEY_COLUMNS) -> DataFrame:
    """``df`` and, for each value of ``by``, one row with the sums of the money columns under ``label``; is_total tells it apart, its ``order`` is the last one's."""
    kinds = dict(df.dtypes)
    quoted = lambda c: F.col(f"`{c}`")
    texts = [c for c in df.columns if c not in (by, order)]
    place, summed = label_column(texts, kinds), {c for c in money if c in texts}
    cells = [F.sum(quoted(c)).alias(c) if c in summed else F.first(F.lit(label if c == place else None).cast(kinds[c])).alias(c) for c in texts]
    total = df.groupBy(quoted(by)).agg(F.max(quoted(order)).alias(order), *cells)
    return df.withColumn("is_total", F.lit(False)).unionByName(total.withColumn("is_total", F.lit(True)))


def subtotals(df: DataFrame, by: Sequence[str], money: Sequence[str]) -> DataFrame:
    """Sums by group and over all groups; the latter's keys are null."""
    return df.rollup(*by).agg(*[F.sum(c).alias(f"sum_{c}") for c in money])


def column_widths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, width): the longest text, header included, and two, from 10 to 40; one pass for all columns."""
    longest = df.agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))).alias(f"w{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.greatest(F.lit(10), F.least(F.lit(40), F.greatest(F.coalesce(f"w{i}", F.lit(0)), F.lit(len(c))) + 2)).alias("width")) for i, c in enumerate(columns)])
    return longest.select(F.inline(pairs))


def json_records(df: DataFrame) -> DataFrame:
    """(record): each row as JSON, nulls kept, numbers that are none as null."""
    safe = [F.when(F.isnan(F.col(f"`{c}`")) | (F.abs(F.col(f"`{c}`")) == float("inf")), None).otherwise(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("record"))


def summary_sheet(summary: DataFrame) -> DataFrame:
    """(Metric, Value) as text, of summary values."""
    return summary.select(F.col("label").alias("Metric"), F.coalesce(F.col("value_num").cast("string"), F.col("value_text"), F.lit("")).alias("Value"))


def keep_newest(df: DataFrame, order: Sequence[Column], n: int = 32) -> DataFrame:
    """The ``n`` newest rows by ``order``; a sort of n rows a task, not of the table."""
    return df.orderBy(*order).limit(n)


def drop_repeats(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row in ``order`` of each combination of ``keys``."""
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.col(order)).alias("row"))
    return kept.select("row.*")


def to_workbook(df: DataFrame, path: str, rates: dict[str, float] | None = None) -> str:
    """Writes the transactions in their order, their EGP amounts and last the subtotal as one CSV part, or as a workbook where openpyxl is installed and ``path`` ends in .xlsx."""
    numbered = with_egp(df, rates).withColumn("__at", F.monotonically_increasing_id())
    # Joining partitions into one file keeps no order, so the one task sorts.
    out = with_subtotal(numbered).repartition(1).sortWithinPartitions("is_total", "__at").drop("is_total", "__at")
    if not path.endswith(".xlsx"):
        out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
        return path
    from openpyxl import Workbook

    book = Workbook()
    sheet = book.active
    sheet.title = "Invoices"
    sheet.append(out.columns)
    for row in out.toLocalIterator():
        sheet.append(list(row))
    book.save(path)
    return path
