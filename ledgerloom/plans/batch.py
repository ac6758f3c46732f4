"""One plan for a batch of documents of all kinds: routed, read, mapped and checked together, with errors as rows.

Every step works on all documents by key, so the plan is the same for one document or a million. Nothing that is wrong
with a document ends the job: it has an error in the results and no transactions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import mapping, matching, tables
from ledgerloom.operators.rows import standardize_rows
from ledgerloom.plans.pipelines import as_notes, box_text, extract, recognised_cells
from ledgerloom.sources.rules import Rules, rule_tables
from ledgerloom.sources.store import settle

#: The key of documents that no supplier's profile was used for.
DYNAMIC = "auto_detected"


@dataclass
class Batch:
    """transactions: doc_id, table_id, row_idx, the standard columns and supplier. summary: doc_id, label, value_num,
    value_text. results: doc_id, route (ocr or text), supplier (a profile's, or auto_detected), n_rows and error, a row a document."""

    transactions: DataFrame
    summary: DataFrame
    results: DataFrame


def route(docs: DataFrame) -> DataFrame:
    """``docs`` (name, engine, text, pages) with route (ocr, text or null) and error.

    Images are recognised whatever engine is asked for; other files as ``mapping.choose_engine`` says.
    """
    image, engine = S.is_image("name"), mapping.choose_engine(F.col("engine"), S.needs_ocr("text", "pages"))
    kind = S.is_document("name") | image
    error = F.when(~kind, F.concat(F.lit("unsupported file type: "), F.coalesce("name", F.lit("")))).when(~image, engine["error"])
    return docs.withColumn("route", F.when(kind, F.when(image, "ocr").otherwise(engine["value"]))).withColumn("error", error)


def run(docs: DataFrame, cells: DataFrame, boxes: DataFrame, rules: Rules, year_now: int, broken: DataFrame | None = None) -> Batch:
    """The whole way of a mixed batch.

    ``docs``: doc_id, name, engine (auto, ocr, text; null: auto), supplier (forced key or null), text and pages. ``cells``:
    the grids of documents read as text; ``boxes``: what was recognised on the others; either may hold documents that go
    the other way, which are left out. ``broken`` (doc_id, error) tells of documents whose reading failed.

    A forced supplier that has a profile is used as it is. Without one, texts name their supplier: read documents take its
    profile, recognised ones only where their headers fit it, as those are noisy; all others are mapped by header. A forced
    key without a profile sends read documents to the header mapper and leaves recognised ones to detection.
    """
    known = rule_tables(docs.sparkSession, rules)
    declared = docs.sparkSession.createDataFrame([(k,) for k in rules.suppliers], "forced string").withColumn("has_profile", F.lit(True))
    failed = broken.groupBy("doc_id").agg(F.min("error").alias("failed")) if broken is not None else docs.select("doc_id", F.lit(None).cast("string").alias("failed")).limit(0)
    routed = route(docs).withColumnRenamed("supplier", "forced").join(declared, "forced", "left").join(failed, "doc_id", "left")
    routed = settle(routed.withColumn("error", F.coalesce("error", "failed")).drop("failed"), "routed")
    going = routed.where("error is null").select("doc_id", "route", "forced", F.coalesce("has_profile", F.lit(False)).alias("has_profile"))

    boxes = boxes.join(going.where("route = 'ocr'").select("doc_id"), "doc_id", "left_semi")
    said = routed.where("error is null and route = 'text'").select("doc_id", "text").unionByName(box_text(boxes))
    found = matching.detect_suppliers(said, known["supplier_identifiers"]).withColumnRenamed("supplier", "named")
    asked = F.when(F.col("has_profile"), F.col("forced")).when((F.col("route") == "ocr") | F.col("forced").isNull(), F.col("named"))
    chosen = settle(going.join(found, "doc_id", "left").withColumn("supplier", asked), "chosen")

    read = cells.join(chosen.where("route = 'text'").select("doc_id"), "doc_id", "left_semi").withColumn("displayed", F.lit(True))
    seen = recognised_cells(boxes, known["supplier_labels"], chosen.where("route = 'ocr' and supplier is not null").select("doc_id", "supplier"))
    kind = cells.schema["doc_id"].dataType
    grids = read.unionByName(seen.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("displayed", F.lit(False)))
    out = extract(grids, fix_arabic="displayed")

    headers = settle(out.headers, "all headers")
    profiled = settle(mapping.map_profile(headers.join(chosen.where("supplier is not null").select("doc_id", "supplier"), "doc_id"), rules), "mapped")
    fits = mapping.profile_fits(profiled).join(chosen.select("doc_id", "route", "has_profile"), "doc_id").where("fits or has_profile or route = 'text'").select(*tables.TABLE)
    fits = settle(fits, "fits")
    by_profile = profiled.join(fits, list(tables.TABLE), "left_semi").select(*tables.TABLE, "col_idx", "header", "standard_column", "note_label")
    by_header = mapping.map_columns(headers.join(fits, list(tables.TABLE), "left_anti"), columns=rules.standard_columns)
    by_header = as_notes(by_header).select(*tables.TABLE, "col_idx", "header", "standard_column", "note_label")
    rows = standardize_rows(out.rows, by_profile.unionByName(by_header), year_now, rules.standard_columns)
    who = fits.join(chosen.select("doc_id", "supplier"), "doc_id")
    rows = rows.join(who, list(tables.TABLE), "left").withColumn("supplier", F.coalesce("supplier", F.lit(DYNAMIC)))
    rows = settle(rows, "transactions")

    counts = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("supplier", F.when(F.col("supplier") != DYNAMIC, 1).otherwise(0)).alias("supplier"))
    results = routed.select("doc_id", "route", "error").join(counts, "doc_id", "left")
    error = F.when(F.col("error").isNull() & F.col("n_rows").isNull(), "no table found").otherwise(F.col("error"))
    results = results.select("doc_id", "route", F.coalesce("supplier", F.when(error.isNull(), DYNAMIC)).alias("supplier"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), error.alias("error"))
    return Batch(rows, out.summary, results)
