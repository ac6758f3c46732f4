"""Extension: JSON replies as they arrive in a folder, through the same plans as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.pipelines import review_replies
from ledgerloom.sources.readers import name_below


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (doc_id, reply), one row a file."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return files.select(name_below(F.input_file_name(), path).alias("doc_id"), F.col("value").alias("reply"))


def review_stream(replies: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's checked results to ``out``, a folder a batch, so a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        review_replies(batch)[1].write.mode("overwrite").parquet(f"{out}/batch={number}")

    return replies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
