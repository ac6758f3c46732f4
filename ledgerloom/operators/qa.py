"""Checks of a batch: do rows add up to the footer, which invoices need a look, how much was found."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S


def verdict(total: Column, net: Column, footer_total: Column, footer_net: Column, tolerance: float = K.REVIEW_TOLERANCE) -> Column:
    """MISMATCH where a sum is off by more than the tolerance, NO FOOTER where the total's footer is missing, else OK."""
    off = lambda s, f: F.coalesce(F.abs(F.coalesce(s, F.lit(0.0)) - f) > tolerance, F.lit(False))
    return F.when(off(total, footer_total) | off(net, footer_net), "MISMATCH").when(footer_total.isNull(), "NO FOOTER").otherwise("OK")


def review(rows: DataFrame, footers: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total_sum, net_sum, review) for every footer row: ``rows`` has total and net, ``footers`` footer_total and footer_net.

    A document without rows sums to 0. Rows are added up before the join.
    """
    sums = rows.groupBy(key).agg(F.sum(S.to_number("total")).alias("total_sum"), F.sum(S.to_number("net")).alias("net_sum"))
    joined = footers.join(sums, key, "left")
    judged = verdict(F.col("total_sum"), F.col("net_sum"), S.to_number("footer_total"), S.to_number("footer_net"))
    return joined.select(key, F.coalesce("total_sum", F.lit(0.0)).alias("total_sum"), F.coalesce("net_sum", F.lit(0.0)).alias("net_sum"), judged.alias("review"))


def box_statistics(boxes: DataFrame, words: Iterable[str] = ("date", "hotel")) -> DataFrame:
    """(doc_id, page, boxes, max_x1, max_y1, has_<word>): how much a recognizer found on a page, and whether it found the words, in any case."""
    has = [F.coalesce(F.bool_or(F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(w))), F.lit(False)).alias(f"has_{w}") for w in words]
    return boxes.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("boxes"), F.coalesce(F.max("x1"), F.lit(0.0)).alias("max_x1"), F.coalesce(F.max("y1"), F.lit(0.0)).alias("max_y1"), *has)


def flagged(reviewed: DataFrame) -> DataFrame:
    return reviewed.where(F.col("review").isin("MISMATCH", "NO FOOTER"))


def batch_totals(results: DataFrame, error: str = "error") -> DataFrame:
    """One row: total, succeeded, failed."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(error).isNull()).alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"))


def detected_columns(df: DataFrame, columns: Iterable[str], by: tuple[str, ...] = ()) -> DataFrame:
    """detected: how many of ``columns`` hold a value that isn't null or blank in some row, for each group of ``by``."""
    some = [F.coalesce(F.max(F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) != "", F.lit(False))), F.lit(False)).cast("int") for c in columns if c in df.columns]
    return df.groupBy(*by).agg(sum(some, F.lit(0)).cast("bigint").alias("detected"))
