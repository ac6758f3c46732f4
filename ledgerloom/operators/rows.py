"""Grids as rows: one row a grid row, its cells as an array, so that all that concerns a table shares one exchange.

The long form of ``tables`` asks for a join or a window by cell at each step. Here cells are gathered once, dealt out by
table; what a row is (strip, block, header, data or summary) follows from windows over the table's rows, which all use that
exchange, and values are looked up in arrays. Both forms give the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S
from ledgerloom.operators.standardize import typed
from ledgerloom.operators.tables import TABLE, dedupe_headers

#: What a row of a grid is.
STRIP, VALUES, BLOCK, HEADER, DATA, OTHER = "strip", "values", "block", "header", "data", "other"


def to_rows(cells: DataFrame, keep: Iterable[str] = (), together: bool = False) -> DataFrame:
    """(doc_id, table_id, row_idx, c, keep): a row a grid row, c its cells by column; cells that the grid lacks are null. ``keep`` is the same for all of a row.

    ``together`` tells that ``cells`` come from an exchange by doc_id, which then serves here too; rows are the same either way.
    """
    # A window, as collecting by group would sort cells, then rows, and the windows to come would sort rows again.
    row = W.partitionBy(*TABLE, "row_idx").orderBy("col_idx")
    pairs = F.array_sort(F.collect_list(F.struct("col_idx", "cell")).over(row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = (cells if together else cells.repartition(*TABLE)).withColumns({"p": pairs, "__nth": F.row_number().over(row)}).where("__nth = 1")
    last = F.element_at("p.col_idx", -1)
    whole = F.transform("p", lambda x: x["cell"])
    filled = F.transform(F.sequence(F.lit(0), last), lambda i: F.get(F.filter("p", lambda x: x["col_idx"] == i), F.lit(0))["cell"])
    return rows.select(*TABLE, "row_idx", F.when(F.size("p") == last + 1, whole).otherwise(filled).alias("c"), *keep)


def _many(c: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(c, lambda x: F.coalesce(test(x), F.lit(False))))


def _some(c: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.exists(c, lambda x: F.coalesce(test(x), F.lit(False)))


def classify(rows: DataFrame, fix_arabic: bool | str = True, arabic_labels: bool = False, min_filled: int | None = None, strict: bool = True) -> DataFrame:
    """``rows`` with role and, on header rows, names (an array of header texts by column; null where the table has no such column) and, on strips, below (the row under it).

    The parameters are those of ``pipelines.extract``; data rows' cells are put in reading order.
    """
    by, whole = W.partitionBy(*TABLE).orderBy("row_idx"), W.partitionBy(*TABLE)
    here = lambda at: F.coalesce(F.col("row_idx") == at, F.lit(False))
    r = rows.withColumns({"filled": _many("c", lambda x: x != ""), "wordy": _many("c", lambda x: x.rlike(r"\p{L}")), "strip": _many("c", lambda x: x.rlike(K.INVOICE_LABEL)) >= 2})
    # A strip's values stand in the row under it.
    under = F.coalesce(F.lag("strip").over(by) & (F.lag("row_idx").over(by) == F.col("row_idx") - 1), F.lit(False))
    r = r.withColumns({"kept": ~F.col("strip") & ~under, "below": F.when(F.lead("row_idx").over(by) == F.col("row_idx") + 1, F.lead("c").over(by))})
    kept = lambda c: F.when(F.col("kept"), c)
    c0 = F.get("c", F.lit(0))
    r = r.withColumns({
        "wide": F.max(kept(F.size("c"))).over(whole), "top": F.min_by(c0, kept(F.when(c0.isNotNull(), F.col("row_idx")))).over(whole),
        "labels": F.count_if(F.col("kept") & (c0 != "")).over(whole), "hits": F.count_if(F.col("kept") & F.lower(c0).isin(*K.SUMMARY_WORDS)).over(whole),
        "next_kept": F.lead("kept").over(by),
    })
    enough = F.col("hits") * 2 > F.col("labels") if strict else F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("labels") / 2))
    block = F.coalesce((F.col("wide") == 2) & F.col("top").rlike(K.SUMMARY_LABEL), F.lit(False)) | ((F.col("labels") > 0) & enough)
    fit = (F.col("filled") >= F.greatest(F.lit(2), F.floor(F.col("wide") / 2))) & (F.col("wordy") >= F.floor(F.col("filled") / 2))
    r = r.withColumns({"block": block, "header_idx": -F.max(kept(F.struct(fit.alias("fit"), "filled", (-F.col("row_idx")).alias("at")))).over(whole)["at"]})
    # The header's names, from its row and the one below.
    order = lambda x: F.when(F.col(fix_arabic), S.fix_arabic(x)).otherwise(F.coalesce(x, F.lit(""))) if isinstance(fix_arabic, str) else S.fix_arabic(x) if fix_arabic else F.coalesce(x, F.lit(""))
    under_it = F.when(F.col("next_kept"), F.coalesce("below", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(F.arrays_zip(F.col("c").alias("t"), under_it.alias("b")), lambda x: F.struct((x["t"].isNotNull() | x["b"].isNotNull()).alias("there"), order(x["t"]).alias("t"), order(x["b"]).alias("b")))
    r = r.withColumn("pairs", F.when(here(F.col("header_idx")), pairs))
    n_top, n_below = _many("pairs", lambda x: x["t"] != ""), _many("pairs", lambda x: x["b"] != "")
    second = (n_below > 0) & (n_below < n_top) & _some("pairs", lambda x: (x["b"] != "") & (x["t"] == "")) & ~_some("pairs", lambda x: x["b"].rlike(r"\p{Nd}"))
    r = r.withColumn("second", F.when(F.col("pairs").isNotNull(), F.coalesce(second, F.lit(False))))
    named = lambda x: F.when(F.col("second"), F.trim(F.concat_ws(" ", F.nullif(x["t"], F.lit("")), F.nullif(x["b"], F.lit(""))))).otherwise(x["t"])
    r = r.withColumn("names", F.transform("pairs", lambda x: F.when(x["there"], named(x))))
    r = r.withColumns({"start": F.col("header_idx") + F.max(F.col("second").cast("int")).over(whole), "n_names": F.max(_many("names", lambda x: x.isNotNull())).over(whole)})
    data = F.col("kept") & ~F.col("block") & F.coalesce(F.col("row_idx") > F.col("start"), F.lit(False))
    at = F.min(F.when(data, F.array_position(F.transform("c", lambda x: x.isNotNull()), True) - 1)).over(whole).cast("int")
    r = r.withColumns({"data": data, "first": at})
    name = F.lower(F.trim(F.coalesce(F.nullif(F.get("names", F.col("first")), F.lit("")), F.concat(F.lit("unnamed_"), "first"))))
    r = r.withColumn("first_name", F.max(F.when(F.col("names").isNotNull(), name)).over(whole))
    # Totals, repeated headers, labels and nearly empty rows are no data.
    t = F.trim(F.coalesce(F.get("c", F.col("first")), F.lit("")))
    low = F.lower(t)
    summary = low.isin(*K.TOTAL_LABELS) | (low == F.col("first_name")) | low.isin(*K.SUMMARY_WORDS) | low.startswith("t.cost") | low.startswith("t cost")
    if arabic_labels:
        summary = summary | S.has_arabic(t)
    labelled = _some("c", lambda x: F.trim(x).rlike(K.SUMMARY_CELL) | F.trim(x).rlike(K.SUMMARY_ROW) | F.trim(x).rlike(K.INVOICE_LABEL))
    least = F.lit(min_filled) if min_filled is not None else F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("n_names") / 2)))
    keep = ~F.coalesce(summary, F.lit(False)) & ~labelled & (_many("c", lambda x: F.trim(x) != "") >= least)
    role = F.when(F.col("strip"), STRIP).when(~F.col("kept"), VALUES).when(F.col("block"), BLOCK).when(F.col("names").isNotNull(), HEADER).when(F.col("data") & keep, DATA).otherwise(OTHER)
    r = r.withColumn("role", role)
    return r.select(*rows.columns[:3], F.when(F.col("role") == DATA, F.transform("c", order)).otherwise(F.col("c")).alias("c"), *rows.columns[4:], "role", F.when(F.col("role") == HEADER, F.col("names")).alias("names"), F.when(F.col("role") == STRIP, F.col("below")).alias("below"))


def headers_of(classified: DataFrame) -> DataFrame:
    """(doc_id, table_id, col_idx, header) with blank and repeated names settled."""
    names = classified.where(F.col("role") == HEADER).select(*TABLE, F.posexplode("names").alias("col_idx", "header")).where("header is not null")
    return dedupe_headers(names)


def block_values(classified: DataFrame) -> DataFrame:
    """(doc_id, label, value_num, value_text) of summary blocks; the last row of a label counts, a missing value is null."""
    pair = classified.where(F.col("role") == BLOCK).select(*TABLE, "row_idx", F.get("c", F.lit(0)).alias("label"), F.get("c", F.lit(1)).alias("value")).where("label <> ''")
    last = pair.groupBy("doc_id", "label").agg(F.max_by("value", F.struct("table_id", "row_idx")).alias("value"))
    return _values(last)


def strip_values(classified: DataFrame) -> DataFrame:
    """(doc_id, label, value_num, value_text) of metadata strips; a label's first value counts."""
    each = classified.where(F.col("role") == STRIP).select(*TABLE, "row_idx", "below", F.posexplode("c").alias("col_idx", "label")).where("label <> ''")
    each = each.withColumn("value", F.get("below", F.col("col_idx"))).where("value <> ''")
    return _values(each.groupBy("doc_id", "label").agg(F.min_by("value", F.struct("table_id", "row_idx", "col_idx")).alias("value")))


def _values(pairs: DataFrame) -> DataFrame:
    money = pairs.withColumn("money", S.parse_money("value"))
    return money.select("doc_id", "label", F.col("money.num").alias("value_num"), F.col("money.txt").alias("value_text"))


def standardize_rows(rows: DataFrame, mapped: DataFrame, year_now: int, columns: Iterable[str] = K.STANDARD_COLUMNS) -> DataFrame:
    """``standardize.standardize`` of data rows (doc_id, table_id, row_idx, c).

    ``mapped`` tells for (doc_id, table_id, col_idx, header) the standard_column or the note_label. One join brings each
    table's sources to its rows, where values are looked up.
    """
    columns = list(columns)
    named = mapped.withColumn("money", S.is_money_header("header"))
    source = lambda c: F.min(F.when(F.col("standard_column") == c, F.struct("col_idx", "money")))
    note = F.when(F.col("note_label").isNotNull(), F.struct("col_idx", "note_label", "money"))
    tables = named.groupBy(*TABLE).agg(*[source(c).alias(f"s{i}") for i, c in enumerate(columns) if c != "Notes"], F.array_sort(F.collect_list(note)).alias("labels"))
    joined = rows.join(tables, list(TABLE), "left")

    def value(s: Column) -> Column:
        text = F.get("c", s["col_idx"])
        return F.when(s["money"], S.money_text(text)).otherwise(text)

    notes = F.transform("labels", lambda n: F.struct(n["note_label"].alias("label"), F.trim(value(n)).alias("text")))
    notes = F.filter(notes, lambda n: n["text"].isNotNull() & ~n["text"].isin(*K.BLANK_MARKS))
    joined = joined.withColumn("notes", F.transform(notes, lambda n: F.concat_ws(": ", F.nullif(n["label"], F.lit("")), n["text"])))
    joined = joined.select(*TABLE, "row_idx", *[value(F.col(f"s{i}")).alias(f"v{i}") for i, c in enumerate(columns) if c != "Notes"], F.coalesce(F.array_join("notes", " | "), F.lit("")).alias("notes"))
    return joined.select(*TABLE, "row_idx", *[F.col("notes").alias(c) if c == "Notes" else typed(c, F.col(f"v{i}"), year_now).alias(c) for i, c in enumerate(columns)])
