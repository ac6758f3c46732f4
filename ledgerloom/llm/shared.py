"""What several operators of this subpackage need: shared storage, documents as Arrow batches, fold hashes."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from importlib.util import find_spec

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WHITESPACE = r"\x20\x09-\x0D"
WORD = f"[^{WHITESPACE}]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver see: ``spark.checkpoint.dir``.

    Where none is named and everything runs in this process (tests), a fresh local folder, which goes when the process ends.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("ledgerloom.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("ledgerloom.shared.dir", root)
    return root


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledgerloom-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Removes all tables that this application has written between steps; call it once results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_home(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back: lineage is cut and a lost executor takes nothing with it.

    ``group_bytes`` bounds the row groups where rows are so large that a reader's batch of them would be too much.
    """
    path = f"{_home(df.sparkSession)}/{uuid.uuid4().hex}/{name}"
    writer = df.write.option("compression", "zstd")
    if group_bytes:
        writer = writer.option("parquet.block.size", group_bytes)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(col: str = "text") -> Column:
    """The text's UTF-8 bytes; a null text counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n``; a null id counts as the empty string."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 8 << 20, max_rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` holding about ``max_bytes`` of ``column`` each (one row at least) and ``max_rows`` at most, so working memory does not follow the batch size.

    ``column`` may be a field of a struct, as in "row.text".
    """
    if batch.num_rows == 0:
        return
    name, _, part = column.partition(".")
    texts = batch.column(name).field(part) if part else batch.column(name)
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right"))), start + max_rows)
        yield batch.slice(start, stop - start)
        start = stop


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine; looked up on the executor, never copied."""
    if find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Each text's number of words, and all texts' words one after the other, coded by a dictionary of large strings.

    Lower-casing (A-Z) comes before the cast to large strings: after it, Arrow's kernel misreads slices.
    """
    lists = pc.ascii_split_whitespace((pc.ascii_lower(texts) if lower else texts).cast(pa.large_string()))
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)  # white space at a text's ends leaves empty words
    before = np.r_[0, np.cumsum(filled.to_numpy(zero_copy_only=False))]
    return np.diff(before[lists.offsets.to_numpy()]), flat.filter(filled).dictionary_encode()


def codes(words: pa.DictionaryArray) -> np.ndarray:
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
