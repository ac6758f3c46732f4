"""Hilbert-curve sharding: rows are ordered along a space-filling curve through their metadata and cut into runs.

Each dimension is quantised into ``2**bits`` equi-depth bins from exact value counts, the bins are the coordinates of a
cell, and the cell's place on the Hilbert curve orders the rows. Neighbouring rows agree in several dimensions at once,
so a reader that filters on any of them skips most of the files.

The global rank needs no total sort: rank = offset of the cell + offset of the row's salt within the cell + row number
within (cell, salt). Only the last is computed over rows, and a cell that holds a third of the table is split over all
salts, which hash the whole row. Bins come from running counts over the values of one dimension at a time; many values are
counted by ranges of them, so no task sees them all, and tables are broadcast only below a checked number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.llm.shared import documents, materialize, parts_for

SHARDS = 8
#: Values of a dimension that one task puts in order, and rows of a lookup table that may be broadcast.
VALUES_PER_TASK, BROADCAST_ROWS = 100_000, 100_000
#: Rows that one salt of one cell should hold if all rows lay in one cell.
ROWS_PER_SALT = 20_000
MIN_SALTS = 64


def curve_index(coords: list[np.ndarray], bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with ``bits``-bit coordinates (Skilling's transpose form, 2004), vectorised."""
    x = [np.asarray(c, dtype=np.int64).copy() for c in coords]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        flip = np.where(x[n - 1] & q, flip ^ (q - 1), flip)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ flip) >> b) & 1)
    return out


def size_class(size: Column) -> Column:
    """An integer that grows with ``size`` (1 or more) in eight steps for each doubling; at most 504 values."""
    width = F.length(F.bin(size))
    return (width * 8 + F.call_function("shiftright", F.shiftleft(size, 3), width - 1) - 8).cast("int")


def _running(df: DataFrame, order: Column, n: str, total: str) -> DataFrame:
    """Adds ``total``: the sum of ``n`` over all rows before, in one task (of a bounded number of rows)."""
    return df.withColumn(total, F.coalesce(F.sum(n).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def _bins(rows: DataFrame, name: str, total: int, bits: int, values_per_task: int) -> DataFrame:
    """(__v, bin): each value's equi-depth bin, by the number of rows with smaller values; null is the smallest."""
    values = materialize(rows.groupBy(name).agg(F.count(F.lit(1)).alias("__m")), "hilbert_values")
    ascending, tasks = F.col(name).asc_nulls_first(), parts_for(values.count(), values_per_task)
    if tasks == 1:
        counted = _running(values, ascending, "__m", "__before")
    else:
        ranged = materialize(values.repartitionByRange(tasks, ascending).withColumn("__part", F.spark_partition_id()), "hilbert_ranges")
        parts = _running(ranged.groupBy("__part").agg(F.sum("__m").alias("__p")), F.col("__part"), "__p", "__first")
        within = F.sum("__m").over(W.partitionBy("__part").orderBy(ascending).rowsBetween(W.unboundedPreceding, -1))
        counted = ranged.join(parts, "__part").withColumn("__before", F.col("__first") + F.coalesce(within, F.lit(0)))
    return counted.select(F.col(name).alias("__v"), F.expr(f"int(__before * {1 << bits} div {max(total, 1)})").alias("bin"))


def _small(df: DataFrame) -> DataFrame:
    """A written table with a hint to broadcast it if it has few rows."""
    df = materialize(df, "hilbert_lookup")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def hilbert_shards(df: DataFrame, dims: list[str], key: str = "doc_id", tie: str | None = None, shards: int = SHARDS, bits: int = 4, values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Adds hilbert (long), shard (int) and slot (long, gapless from 0 in each shard); shard sizes differ by one row at most.

    ``dims`` names the columns to cluster by. Within a cell rows are ordered by a hash of key and ``tie`` (a column that
    tells rows of one key apart), then by key, nulls first, then by tie. Nulls are the smallest value of a dimension, rows
    that agree in all of these get slots of their own in any order, an empty table stays empty, and other columns pass
    through (they must not be called hilbert, shard or slot).
    """
    clash = {"hilbert", "shard", "slot"} & set(df.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    names = [f"__dim{i}" for i in range(len(dims))]
    rows = materialize(df.withColumns({n: F.col(d) for n, d in zip(names, dims, strict=True)}), "hilbert_rows")
    total = rows.count()
    binned = rows
    for n in names:
        bins = _small(_bins(rows, n, total, bits, values_per_task))
        binned = binned.join(bins, F.col(n).eqNullSafe(F.col("__v"))).drop("__v", n).withColumnRenamed("bin", f"{n}_bin")

    @F.pandas_udf("long")
    def place(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(curve_index([frame[c].to_numpy() for c in frame.columns], bits))

    at = [f"{n}_bin" for n in names]
    cells = _small(binned.groupBy(*at).agg(F.count(F.lit(1)).alias("__n")).withColumn("hilbert", place(F.struct(*at))))
    salts = max(MIN_SALTS, total // ROWS_PER_SALT)
    ties = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (key, tie) if c]
    salt = F.conv(F.substring(F.md5(F.concat_ws(":", *ties).cast("binary")), 1, 8), 16, 10).cast("long") % salts
    placed = binned.join(cells.select(*at, "hilbert"), at).drop(*at).withColumn("__salt", salt)
    # As many rows as cells on the curve and salts: one task puts the cells in order, each cell's salts are put in order apart.
    counts = cells.groupBy("hilbert").agg(F.sum("__n").alias("__c"))
    cell_start = _small(_running(counts, F.col("hilbert"), "__c", "__cell_start").select("hilbert", "__cell_start"))
    salted = placed.groupBy("hilbert", "__salt").agg(F.count(F.lit(1)).alias("__s"))
    within = F.coalesce(F.sum("__s").over(W.partitionBy("hilbert").orderBy("__salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = salted.select("hilbert", "__salt", within.alias("__within")).join(cell_start, "hilbert")
    starts = starts.select("hilbert", "__salt", (F.col("__cell_start") + F.col("__within")).alias("__start"))
    order = [F.col(c).asc_nulls_first() for c in (key, tie) if c]
    numbered = placed.withColumn("__row", F.row_number().over(W.partitionBy("hilbert", "__salt").orderBy(*order)) - 1)
    ranked = numbered.join(starts, ["hilbert", "__salt"]).withColumn("__rank", F.col("__start") + F.col("__row"))
    ranked = ranked.withColumn("shard", F.expr(f"int(__rank * {shards} div {max(total, 1)})"))
    ranked = ranked.withColumn("slot", F.expr(f"__rank - (shard * bigint({total}) + {shards - 1}) div {shards}"))
    return ranked.select(*df.columns, "hilbert", "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in curve order, so that row-group statistics prune."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    docs = documents(spark, sf_dir).select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "lang", "source", size_class(size).alias("size_class"))
    out = hilbert_shards(docs, ["source", "lang", "size_class"], tie="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
