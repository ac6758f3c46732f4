"""Sources: files as bytes, recognised boxes, recognizer payloads, JSON replies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S
from ledgerloom.operators.geometry import BOXES
from ledgerloom.sources.store import settle

DUMP = "text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def name_below(file: Column, root: str) -> Column:
    """A file's path below the folder ``root``, so that files of one name in different folders stay apart; of a file named itself, the last part.

    Schemes don't count. A root with wildcards leaves the whole path.
    """
    bare = lambda c: F.regexp_replace(F.replace(c, F.lit("%20"), F.lit(" ")), r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    whole, folder = bare(file), F.concat(F.rtrim(bare(F.lit(root)), F.lit("/")), F.lit("/"))
    return F.when(F.concat(whole, F.lit("/")) == folder, F.element_at(F.split(whole, "/"), -1)).when(whole.startswith(folder), F.substring(whole, F.length(folder) + 1, F.length(whole))).otherwise(whole)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, length, content) of the documents below ``path``; other file types are left out before their bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[pP][dD][fF],[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG]}").load(path)
    return files.select(name_below(F.col("path"), path).alias("doc_id"), "path", "length", "content")


def read_box_dump(spark: SparkSession, path: str) -> DataFrame:
    """Boxes of a tab-separated dump, a page a file; lines that begin with # are left out."""
    raw = spark.read.schema(DUMP).option("sep", "\t").option("comment", "#").option("quote", "").csv(path)
    # A large file is read in splits: its rows are numbered by split, then by place in it.
    named = raw.select("*", name_below(F.col("_metadata.file_path"), path).alias("doc_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    named = named.withColumn("box_id", F.row_number().over(W.partitionBy("doc_id").orderBy("split", "at")) - 1)
    return named.selectExpr("doc_id", "0 as page", "box_id", "text", "x0", "y0", "x1", "y1", "confidence", "double(null) as page_width")


def write_box_dump(boxes: DataFrame, path: str) -> None:
    boxes.select("text", "x0", "y0", "x1", "y1", "confidence").write.option("sep", "\t").option("quote", "").mode("overwrite").csv(path)


def page_text(pages: DataFrame, strip: bool = True) -> DataFrame:
    """(doc_id, text, pages): the pages' texts joined in order, glyph marks stripped or kept."""
    text = S.strip_cid(F.coalesce("text", F.lit(""))) if strip else F.coalesce("text", F.lit(""))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text.alias("t")))), lambda p: p["t"]), "\n")
    return pages.groupBy("doc_id").agg(joined.alias("text"), F.count(F.lit(1)).alias("pages"))


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    return pages.where(F.col("page") < n)


_POINTS = "array<array<double>>"


def bounding_box(points: Column) -> Column:
    """struct<x0, y0, x1, y1> around a polygon's points; zeros where there are none."""
    axis = lambda i: F.transform(points, lambda p: F.get(p, F.lit(i)))
    edge = lambda f, i: F.coalesce(f(axis(i)), F.lit(0.0))
    return F.struct(edge(F.array_min, 0).alias("x0"), edge(F.array_min, 1).alias("y0"), edge(F.array_max, 0).alias("x1"), edge(F.array_max, 1).alias("y1"))


def decode_payloads(payloads: DataFrame) -> DataFrame:
    """Boxes of recognizer answers (doc_id, page, payload as JSON), in either of two shapes.

    One is a list of [polygon, [text, score]]; the other an object with rec_texts, rec_scores and dt_polys, of which
    scores (then 1) and polygons (then zeros) may be missing. Blank texts are left out; answers of other shapes give none.
    """
    pairs = F.from_json("payload", "array<array<string>>")
    listed = payloads.where(F.trim("payload").startswith("[")).select("doc_id", "page", F.posexplode(pairs).alias("box_id", "item"))
    said = F.from_json(F.get("item", F.lit(1)), "array<string>")
    listed = listed.select("doc_id", "page", "box_id", F.get(said, F.lit(0)).alias("text"), F.coalesce(F.get(said, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("confidence"), bounding_box(F.from_json(F.get("item", F.lit(0)), _POINTS)).alias("b"))
    shape = F.from_json("payload", f"rec_texts array<string>, rec_scores array<double>, dt_polys array<{_POINTS}>")
    named = payloads.where(F.trim("payload").startswith("{")).select("doc_id", "page", shape.alias("r"))
    named = named.select("doc_id", "page", "r", F.posexplode("r.rec_texts").alias("box_id", "text"))
    named = named.select("doc_id", "page", "box_id", "text", F.coalesce(F.get("r.rec_scores", F.col("box_id")), F.lit(1.0)).alias("confidence"), bounding_box(F.get("r.dt_polys", F.col("box_id"))).alias("b"))
    both = listed.unionByName(named).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return both.selectExpr("doc_id", "page", "box_id", "text", "b.x0", "b.y0", "b.x1", "b.y1", "confidence", "double(null) as page_width")


def payload_errors(payloads: DataFrame) -> DataFrame:
    """(doc_id, page, error) of recognizer answers (doc_id, page, payload) that can't be read: not JSON, or of neither known shape.

    An empty list of lines is an answer, that of a blank page.
    """
    said = F.trim(F.coalesce("payload", F.lit("")))
    body = S.named(said, lambda t: F.struct(t.alias("t"), F.get_json_object(t, "$").isNotNull().alias("json")))
    listed = lambda t: F.from_json(t, "array<array<string>>")
    right = lambda t: F.when(t.startswith("["), listed(t).isNotNull() & F.forall(listed(t), lambda i: i.isNotNull() & (F.size(i) == 2) & i[1].startswith("["))).otherwise(F.from_json(t, "rec_texts array<string>")["rec_texts"].isNotNull())
    error = F.when(~F.col("b.json"), "payload is not JSON").when(~F.coalesce(right(F.col("b.t")), F.lit(False)), "payload has no lines")
    return payloads.select("doc_id", "page", body.alias("b")).select("doc_id", "page", error.alias("error")).where("error is not null")


def recognize(files: DataFrame, engine: Callable[[bytes], Sequence[tuple[str, tuple[float, float, float, float]]]]) -> DataFrame:
    """Boxes of each file's image by ``engine`` (bytes to texts and boxes), called once a row in Arrow batches on the executors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, 0, i, t, *map(float, box), 1.0, None) for d, content in zip(frame["doc_id"], frame["content"], strict=True) for i, (t, box) in enumerate(engine(content))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "box_id", "text", "x0", "y0", "x1", "y1", "confidence", "page_width"])

    return files.select("doc_id", "content").mapInPandas(run, BOXES)


def image_url(content: Column, name: Column) -> Column:
    """A data URL of an image's or document's bytes."""
    kind = F.when(S.file_extension(name).isin(".jpg", ".jpeg"), "image/jpeg").when(S.file_extension(name) == ".png", "image/png").otherwise("application/pdf")
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64(content))


# JSON replies

_ROW = "map<string,string>"


def strip_fence(c: Column) -> Column:
    """A reply without the code fence around it."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when(t.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^[^\n]*\n?", ""), r"\n?\s*```\s*$", ""))).otherwise(t)


def parse_replies(replies: DataFrame, columns: Sequence[str] = K.REPLY_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(rows, results) of (doc_id, reply).

    rows: doc_id, row_idx and ``columns`` as text, of good replies. results: doc_id, n_rows, footer_total, footer_net and
    error (null for good replies): a reply that isn't JSON, has no rows, or has a row with missing or other keys. One
    bad reply spoils no other. A plain array is rows without a footer.
    """
    found = settle(replies.select("doc_id", S.named(strip_fence(F.col("reply")), lambda t: _parsed(t, columns)).alias("r")).select("doc_id", "r.*"), "replies")
    good = found.where("error is null")
    rows = good.select("doc_id", F.posexplode("rows").alias("row_idx", "r")).select("doc_id", "row_idx", *[F.col("r")[c].alias(c) for c in columns])
    results = found.select("doc_id", F.when(F.col("error").isNull(), F.size("rows")).otherwise(0).alias("n_rows"), "footer_total", "footer_net", "error")
    return rows, results


def _parsed(t: Column, columns: Sequence[str]) -> Column:
    """struct<rows, footer_total, footer_net, error>: a reply is parsed once, and once more only to tell broken JSON from other JSON."""
    body = F.from_json(t, f"rows array<{_ROW}>, footer struct<total:string,net:string>")
    kind = F.substring(t, 1, 1)
    none = F.lit(None).cast("struct<total:string,net:string>")
    either = F.when(kind == "[", F.struct(F.from_json(t, f"array<{_ROW}>").alias("rows"), none.alias("footer"))).when(kind == "{", body)
    want = F.array(*map(F.lit, columns))
    # Lambdas can't look outside their row, so the wanted keys stand in for each.
    wrong = lambda r: r.isNull() | (F.size(F.array_except(want, F.map_keys(r))) > 0) | (F.size(F.array_except(F.map_keys(r), want)) > 0)
    broken = ~kind.isin("[", "{") | F.get_json_object(t, "$").isNull()

    def judged(x: Column) -> Column:
        error = F.when(x["rows"].isNull(), F.when(broken, "not JSON").otherwise("no rows")).when(F.exists(x["rows"], wrong), "wrong keys in a row")
        part = lambda c: x["footer"][c].alias(f"footer_{c}")
        return S.named(error, lambda e: F.struct(F.when(e.isNull(), x["rows"]).alias("rows"), F.when(e.isNull(), part("total")).alias("footer_total"), F.when(e.isNull(), part("net")).alias("footer_net"), e.alias("error")))

    return S.named(either, judged)
