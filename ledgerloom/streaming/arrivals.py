"""Extension: invoice rows and footers that arrive apart, late and twice, checked as a batch would check them.

``rows`` has doc_id, row_idx, total, net and at (when it was sent), ``footers`` doc_id, footer_total, footer_net and at. All
state is bounded by event time: what lies behind the watermark is emitted and forgotten. The same functions take tables,
and give the same rows for them, in whatever order a stream's batches come, as long as nothing is later than ``delay``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.functions import scalars as S


def once(df: DataFrame, keys: list[str], at: str = "at", delay: str = "1 hour") -> DataFrame:
    """``df`` with the first of the rows of equal ``keys``; a stream forgets a key once the watermark has passed it by ``delay``."""
    if df.isStreaming:
        return df.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def sessions(df: DataFrame, keys: list[str], gap: str, aggregates: list[Column], at: str = "at") -> DataFrame:
    """(keys, began, ended, the aggregates) of each run of rows of equal ``keys`` that are at most ``gap`` apart in time.

    These are the islands of ``geometry.islands`` over time: a stream emits one when the watermark has passed its end.
    """
    found = df.groupBy(*keys, F.session_window(at, gap).alias("session")).agg(*aggregates)
    return found.select(*keys, F.col("session.start").alias("began"), F.window_time("session").alias("ended"), *[c for c in found.columns if c not in (*keys, "session")])


def reviewed(rows: DataFrame, footers: DataFrame, gap: str = "10 minutes", delay: str = "1 hour", wait: str = "1 hour") -> DataFrame:
    """(doc_id, began, n_rows, sum_total, sum_net, footer_total, footer_net, matches) of each run of a document's rows.

    Rows and footers that are sent again count once. A footer belongs to a run if it was sent between ``wait`` before its
    beginning and ``wait`` after its end; a run without one has null there, once it can no longer come.
    """
    each = once(rows, ["doc_id", "row_idx"], delay=delay)
    sums = [F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce(S.to_number(F.col("total")), F.lit(0.0))).alias("sum_total"), F.sum(F.coalesce(S.to_number(F.col("net")), F.lit(0.0))).alias("sum_net")]
    runs = sessions(each, ["doc_id"], gap, sums)
    ends = once(footers, ["doc_id"], delay=delay).select(F.col("doc_id").alias("footer_doc"), "footer_total", "footer_net", F.col("at").alias("footer_at"))
    within = (F.col("doc_id") == F.col("footer_doc")) & (F.col("footer_at") >= F.col("began") - F.expr(f"interval {wait}")) & (F.col("footer_at") <= F.col("ended") + F.expr(f"interval {wait}"))
    joined = runs.join(ends, within, "leftOuter")
    near = lambda a, b: F.abs(S.to_number(F.col(a)) - F.col(b)) <= 0.01
    matches = F.when(F.col("footer_doc").isNotNull(), F.coalesce(near("footer_total", "sum_total"), F.lit(True)) & F.coalesce(near("footer_net", "sum_net"), F.lit(True)))
    return joined.select("doc_id", "began", "n_rows", "sum_total", "sum_net", "footer_total", "footer_net", matches.alias("matches"))


def start(reviews: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends each review to ``out`` once, as Parquet."""
    return reviews.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
