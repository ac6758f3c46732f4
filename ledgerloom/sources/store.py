"""Tables between the steps of a long plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether the shuffle files that a query wrote go when it ends; Spark keeps them until the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir``.

    Where none is named and everything runs in this process (tests), a fresh local folder, which goes when the process ends.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("ledgerloom.store.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("ledgerloom.store.dir", root)
    return root


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledgerloom-tables-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes all tables that this application has written between steps; call it once results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own among this application's tables."""
    return f"{_home(spark)}/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    What a step reads several times is worked out once, the plan starts anew there, and a lost executor takes nothing
    with it. The shuffle files behind it go as soon as it is written, so the steps' files don't add up on disk.
    """
    path, conf = new_folder(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, None)
    conf.set(SHUFFLES_GO, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(SHUFFLES_GO) if before is None else conf.set(SHUFFLES_GO, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, to be broadcast if it was counted and has at most ``rows`` rows; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
