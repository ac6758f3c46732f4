"""Positioned text boxes to grids.

``boxes(doc_id, page, box_id, text, x0, y0, x1, y1, confidence, page_width)``; every page is on its own, so all steps are
windows and joins on (doc_id, page) and share one exchange.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S
from ledgerloom.functions.similarity import best_of, label_similarity
from ledgerloom.sources.store import settle, small

PAGE = ("doc_id", "page")
BOXES = "doc_id string, page int, box_id int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, page_width double"


def _cx() -> Column:
    return (F.col("x0") + F.col("x1")) / 2


def _cy() -> Column:
    return (F.col("y0") + F.col("y1")) / 2


def islands(df: DataFrame, keys: Sequence[str], at: Column, far: Column, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds ``name``: the number from 0 of the run that a row falls in, when rows ordered by ``at`` part where they are more than ``far`` apart."""
    by = W.partitionBy(*keys).orderBy(at, *order)
    parted = df.withColumn("__part", F.coalesce((at - F.lag(at).over(by) > far).cast("int"), F.lit(0)))
    return parted.withColumn(name, F.sum("__part").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__part")


def merged_spans(df: DataFrame, keys: Sequence[str], low: str, high: str, gap: Column, name: str = "span") -> DataFrame:
    """(keys, name, low, high): intervals joined where the next begins within ``gap`` of all before it; numbered from 0."""
    by = W.partitionBy(*keys).orderBy(low, high)
    reach = F.max(high).over(by.rowsBetween(W.unboundedPreceding, -1))
    parted = df.withColumn("__part", F.coalesce((F.col(low) > reach + gap).cast("int"), F.lit(0)))
    numbered = parted.withColumn(name, F.sum("__part").over(by.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, name).agg(F.min(low).alias(low), F.max(high).alias(high))


def otsu(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, threshold): the midpoint between neighbours in order that parts the values best in two; null for one value."""
    by = W.partitionBy(*keys).orderBy(value)
    upto, whole = by.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys)
    # One struct, so that no key or value column can clash with a working name.
    seen = F.struct(F.row_number().over(by).alias("i"), F.sum(value).over(upto).alias("s"), F.count(F.lit(1)).over(whole).alias("n"), F.sum(value).over(whole).alias("all"), F.lead(value).over(by).alias("next"))
    at = lambda f: F.col(f"__seen.{f}")
    w0 = at("i") / at("n")
    spread = w0 * (1 - w0) * F.pow(at("s") / at("i") - (at("all") - at("s")) / (at("n") - at("i")), 2)
    cut = df.select(*keys, value, seen.alias("__seen")).where("__seen.i < __seen.n").withColumn("__spread", spread)
    best = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("__spread").desc(), at("i")))
    cut = cut.withColumn("__nth", best).where("__nth = 1").select(*keys, ((F.col(value) + at("next")) / 2).alias("threshold"))
    return df.select(*keys).distinct().join(cut, list(keys), "left")


def row_tolerance(boxes: DataFrame, share: float = K.ROW_TOLERANCE) -> DataFrame:
    """(doc_id, page, eps): how far apart neighbouring centres of one row may lie.

    A share of the median height, or less where the gaps between centres fall clearly into two kinds.
    """
    base = boxes.groupBy(*PAGE).agg(F.greatest(F.lit(1.0), F.median(F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))) * share).alias("base"))
    by = W.partitionBy(*PAGE).orderBy(_cy())
    gaps = boxes.select(*PAGE, (_cy() - F.lag(_cy()).over(by)).alias("gap")).where("gap > 1e-6")
    kinds = gaps.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("top"), F.array_sort(F.collect_list("gap")).alias("g"))
    clear = (F.col("n") >= 2) & (F.col("top") > F.element_at("g", F.floor(F.col("n") / 2).cast("int") + 1) * 1.5 + 1.0)
    joined = base.join(kinds.join(otsu(gaps, PAGE, "gap"), list(PAGE)), list(PAGE), "left")
    return joined.select(*PAGE, F.when(clear, F.greatest(F.lit(1.0), F.least("base", "threshold"))).otherwise(F.col("base")).alias("eps"))


def rows_of(boxes: DataFrame) -> DataFrame:
    """``boxes`` with text, and line: the number of the row that a box stands in, from the top."""
    some = boxes.where(F.coalesce("text", F.lit("")) != "")
    return islands(some.join(row_tolerance(some), list(PAGE)), PAGE, _cy(), F.col("eps"), ["box_id"], "line").drop("eps")


def column_bands(boxes: DataFrame, gutter_share: float = K.GUTTER_SHARE) -> DataFrame:
    """(doc_id, page, band, b0, b1): stretches of the width with content, parted by empty gutters wide enough.

    Edges are whole pixels. The last band reaches to the page's edge unless a gutter follows it.
    """
    width = F.greatest(F.lit(1), F.bround("page_width").cast("int"))
    clip = lambda c: F.least(width, F.greatest(F.lit(0), F.bround(c).cast("int")))
    spans = boxes.select(*PAGE, width.alias("width"), clip("x0").alias("b0"), clip("x1").alias("b1")).where("b1 > b0")
    gutter = F.greatest(F.lit(1), F.floor(F.col("width") * gutter_share).cast("int"))
    bands = merged_spans(spans.withColumn("gutter", gutter), PAGE, "b0", "b1", F.col("gutter") - 1, "band")
    page = spans.groupBy(*PAGE).agg(F.max("width").alias("width"))
    last = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.col("band").desc())) == 1
    open_end = F.col("width") - F.col("b1") < F.greatest(F.lit(1), F.floor(F.col("width") * gutter_share))
    bands = bands.join(page, list(PAGE)).withColumn("last", last)
    edge = F.when(F.col("last") & open_end, F.col("width")).otherwise(F.col("b1"))
    return bands.select(*PAGE, "band", F.col("b0").cast("double").alias("b0"), edge.cast("double").alias("b1"))


def _between(spans: DataFrame, right: Column) -> DataFrame:
    """Column strips from label spans (h0, h1): they meet midway between neighbours and reach to the page's edges."""
    by = W.partitionBy(*PAGE).orderBy("span")
    b0 = F.coalesce((F.lag("h1").over(by) + F.col("h0")) / 2, F.lit(0.0))
    b1 = F.coalesce((F.col("h1") + F.lead("h0").over(by)) / 2, right)
    return spans.select(*PAGE, F.col("span").alias("band"), b0.alias("b0"), b1.alias("b1"))


def header_bands(rows: DataFrame) -> DataFrame:
    """(doc_id, page, band, b0, b1) from the gaps of the fullest row, for pages where that row is wide and full enough to be a header."""
    size = rows.groupBy(*PAGE, "line").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("left"), F.max_by("x1", F.struct("x0", "x1")).alias("right"), F.max("page_width").alias("page_width"))
    best = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.col("n").desc(), "line"))
    wide = size.withColumn("k", best).where("k = 1").where((F.col("n") >= K.HEADER_LEAST_BOXES) & (F.col("page_width") > 0) & (F.col("right") - F.col("left") >= K.HEADER_LEAST_SPAN * F.col("page_width")))
    labels = rows.drop("page_width").join(wide.select(*PAGE, "line", "page_width"), [*PAGE, "line"]).withColumns({"h0": F.col("x0"), "h1": F.col("x1")})
    spans = merged_spans(labels, PAGE, "h0", "h1", F.greatest(F.lit(2.0), F.col("page_width") * K.HEADER_MERGE_SHARE))
    spans = spans.join(wide.select(*PAGE, "page_width"), list(PAGE)).withColumn("m", F.count(F.lit(1)).over(W.partitionBy(*PAGE))).where("m >= 2")
    return _between(spans, F.col("page_width"))


def assign_bands(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """``rows`` with band: the one that a box overlaps most, the first in a tie; without overlap, the nearest by its middle."""
    overlap = F.least("x1", "b1") - F.greatest("x0", "b0")
    near = rows.join(bands, list(PAGE)).withColumns({"overlap": overlap, "away": F.abs(_cx() - (F.col("b0") + F.col("b1")) / 2)})
    hit = F.when(F.col("overlap") > 0, F.col("overlap")).otherwise(0.0)
    best = F.row_number().over(W.partitionBy(*PAGE, "box_id").orderBy(hit.desc(), F.when(hit > 0, 0.0).otherwise(F.col("away")), "band"))
    return near.withColumn("k", best).where("k = 1").drop("k", "overlap", "away", "b0", "b1")


#: More parts than a box can hold; new numbers are the box's times this, and its part's.
PARTS = 1 << 20


def expand_packed(boxes: DataFrame) -> DataFrame:
    """Boxes that hold several numbers, and are tall or hold three at least, as one box for each number, from top to bottom."""
    height = F.col("y1") - F.col("y0")
    median = boxes.where(F.coalesce("text", F.lit("")) != "").groupBy(*PAGE).agg(F.median(height).alias("median"))
    values = F.when(F.col("text").rlike(r"[\n\r]"), F.array("text")).otherwise(S.split_numbers("text"))
    split = boxes.join(median, list(PAGE), "left").withColumn("values", values)
    n, h = F.size("values"), F.greatest(F.lit(1.0), height)
    packed = (n > 1) & ((h >= F.coalesce("median", F.lit(15.0)) * 1.3) | (n >= 3))
    split = split.withColumn("values", F.when(packed, F.col("values")).otherwise(F.array("text"))).select("*", F.posexplode("values").alias("part", "value"))
    step = F.greatest(F.lit(1.0), height) / F.size("values")
    one = F.size("values") == 1
    top, bottom = F.when(one, F.col("y0")).otherwise(F.col("y0") + F.col("part") * step), F.when(one, F.col("y1")).otherwise(F.col("y0") + (F.col("part") + 1) * step)
    return split.select(*PAGE, (F.col("box_id").cast("bigint") * PARTS + F.col("part")).alias("box_id"), F.col("value").alias("text"), "x0", top.alias("y0"), "x1", bottom.alias("y1"), "confidence", "page_width")


def to_grid(cells: DataFrame, bands: DataFrame) -> DataFrame:
    """cells(doc_id, table_id, row_idx, col_idx, cell), rectangular, from boxes with line and band; boxes of a cell join from left to right."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_cx().alias("at"), "box_id", "text"))), lambda b: b["text"]), " ")
    filled = cells.groupBy(*PAGE, "line", "band").agg(F.trim(text).alias("cell"))
    full = cells.select(*PAGE, "line").distinct().join(bands.select(*PAGE, "band"), list(PAGE))
    return full.join(filled, [*PAGE, "line", "band"], "left").select("doc_id", F.col("page").alias("table_id"), F.col("line").alias("row_idx"), F.col("band").alias("col_idx"), F.coalesce("cell", F.lit("")).alias("cell"))


def with_page_width(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("page_width", F.coalesce("page_width", F.max("x1").over(W.partitionBy(*PAGE))))


def boxes_to_cells(boxes: DataFrame) -> DataFrame:
    """Grids of pages without a known layout: header gaps give the columns where there is a wide header, gutters elsewhere."""
    rows = settle(rows_of(settle(with_page_width(expand_packed(boxes)), "boxes")), "rows")
    by_header = header_bands(rows)
    by_gutter = column_bands(rows).join(by_header.select(*PAGE).distinct(), list(PAGE), "left_anti")
    bands = settle(by_header.unionByName(by_gutter), "bands")
    return to_grid(settle(assign_bands(rows, bands), "assigned"), bands)


# Known layouts

#: Distinct texts that one task scores by matching blocks: a few seconds' work.
TEXTS_PER_TASK = 20_000


def with_labels(boxes: DataFrame, layouts: DataFrame) -> DataFrame:
    """``boxes`` (supplier, text and others) with label: which of their own supplier's labels the text resembles most, the first in a tie; null: none.

    ``layouts`` has (supplier, label). A text that is a label, or whose words hold all of a label's or the other way, has the
    highest score there is and is told on the spot. Of the others, those that surely resemble none stay out of Python:
    numbers, and texts too long for matching blocks that share no word with a label and contain none.
    """
    return _told(settle(_marked(boxes, layouts), "marked"), layouts).drop("__sure", "__text")


def _names(layouts: DataFrame) -> DataFrame:
    names = layouts.select("supplier", S.normalize_header("label").alias("name")).where("name <> ''").groupBy("supplier").agg(F.array_sort(F.collect_set("name")).alias("names"))
    own = F.transform("names", lambda n: F.struct(n.alias("name"), F.array_distinct(F.split(n, " ")).alias("words")))
    return names.select("supplier", "names", own.alias("own"), F.array_distinct(F.flatten(F.transform("names", lambda n: F.split(n, " ")))).alias("words"), F.exists("names", lambda n: n.rlike(r"\p{Nd}")).alias("digits"), F.array_max(F.transform("names", F.length)).alias("longest"))


def _marked(boxes: DataFrame, layouts: DataFrame) -> DataFrame:
    """``boxes`` with __sure, the label that is told on the spot, and __text, the normalized text where it must be scored. All texts are looked at here, once."""
    names = _names(layouts).select(F.col("supplier").alias("__of"), F.struct("names", "own", "words", "digits", "longest").alias("__l"))
    found = boxes.join(small(names), F.col("supplier") == F.col("__of"), "left")
    # Texts without a letter, most of a page, are not even normalized.
    found = found.withColumn("__plain", F.when(F.col("__l.digits") | F.col("text").rlike(r"\p{L}"), S.normalize_header("text")))
    plain, said = F.col("__plain"), F.col("__said")
    # Blocks that match cover at most the shorter text, so a text over three times as long scores below a half.
    blocks = F.length(plain) * K.TEMPLATE_LABEL_MATCH <= F.col("__l.longest") * (2 - K.TEMPLATE_LABEL_MATCH)
    found = found.withColumn("__said", F.when(plain != "", F.array_distinct(F.split(plain, " "))))
    shared = lambda w: F.size(F.array_intersect(said, w))
    whole = F.filter("__l.own", lambda n: shared(n["words"]) == F.least(F.size(said), F.size(n["words"])))
    found = found.withColumn("__sure", F.when(F.arrays_overlap(said, "__l.words"), F.get(whole, F.lit(0))["name"]))
    may = F.col("__sure").isNull() & said.isNotNull() & (blocks | F.arrays_overlap(said, "__l.words") | F.exists("__l.names", lambda n: F.contains(plain, n)))
    return found.select(*[F.col(f"`{c}`") for c in boxes.columns], "__sure", F.when(may, plain).alias("__text"))


def _told(marked: DataFrame, layouts: DataFrame) -> DataFrame:
    """A written table of ``_marked`` with label."""
    # Written first: a filter on scores would be pushed below the distinct, and every box be scored.
    texts = settle(marked.where("__text is not null").select("supplier", "__text").distinct(), "texts")
    texts = texts.repartition(max(1, min(texts.count() // TEXTS_PER_TASK, 10_000))).join(small(_names(layouts).select("supplier", "names")), "supplier")
    best = texts.withColumn("best", best_of(F.col("__text"), F.col("names"), label_similarity)).where(F.col("best.score") >= K.TEMPLATE_LABEL_MATCH)
    # "Date" stands on nearly every page: the few texts that are labels go to the boxes, not the boxes to them.
    near = small(settle(best.select(F.col("supplier").alias("__of"), F.col("__text").alias("__like"), F.col("best.name").alias("__near")), "labels"))
    found = marked.join(near, (F.col("supplier") == F.col("__of")) & (F.col("__text") == F.col("__like")), "left")
    return found.select(*[F.col(f"`{c}`") for c in marked.columns], F.coalesce("__sure", "__near").alias("label"))


def label_hits(boxes: DataFrame, layouts: DataFrame) -> DataFrame:
    """(supplier, text, label) of the texts of ``boxes`` (supplier, text) that resemble a label of their own supplier's layout."""
    return with_labels(boxes.select("supplier", "text").distinct(), layouts).where("label is not null")


def header_boxes(boxes: DataFrame, layouts: DataFrame) -> DataFrame:
    """The boxes of each page's header: all in the height band that holds the most boxes resembling a label of the supplier.

    ``boxes`` has supplier, the document's own or null; pages without one have no header.
    """
    marked = settle(_marked(boxes, layouts), "marked")
    return _header_boxes(marked, layouts).drop("__sure", "__text", "lo", "hi")


def _header_boxes(marked: DataFrame, layouts: DataFrame) -> DataFrame:
    """``header_boxes`` of a written table of ``_marked``, with the height band (lo, hi)."""
    hits = _told(marked, layouts).where("label is not null").select(*PAGE, "box_id", "y0", "y1")
    middle = hits.groupBy(*PAGE).agg((F.median(F.col("y1") - F.col("y0")) * 0.5).alias("half"))
    grouped = islands(hits.join(middle, list(PAGE)), PAGE, _cy(), F.greatest(F.lit(1.0), F.col("half")), ["box_id"], "group")
    size = grouped.groupBy(*PAGE, "group").agg(F.count(F.lit(1)).alias("n"), F.min(_cy()).alias("lo"), F.max(_cy()).alias("hi"), F.max("half").alias("half"))
    best = F.row_number().over(W.partitionBy(*PAGE).orderBy(F.col("n").desc(), "group"))
    band = size.withColumn("k", best).where("k = 1").withColumn("span", F.greatest(F.lit(1.0), F.col("hi") - F.col("lo"), "half"))
    return marked.join(band.select(*PAGE, (F.col("lo") - F.col("span")).alias("lo"), (F.col("hi") + F.col("span")).alias("hi")), list(PAGE)).where(_cy().between(F.col("lo"), F.col("hi")))


def column_bounds(header: DataFrame) -> DataFrame:
    """(doc_id, page, band, b0, b1, label) strips of a template's header boxes; touching ones are one column with joined labels."""
    boxes = header.withColumns({"h0": F.col("x0"), "h1": F.col("x1")})
    spans = merged_spans(boxes, PAGE, "h0", "h1", F.lit(0.0))
    page = header.groupBy(*PAGE).agg(F.max("page_width").alias("page_width"))
    strips = _between(spans.join(page, list(PAGE)), F.greatest("page_width", "h1"))
    named = boxes.select(*PAGE, "h0", "box_id", "text").join(spans.select(*PAGE, "span", F.col("h0").alias("s0"), F.col("h1").alias("s1")), list(PAGE)).where("h0 >= s0 and h0 <= s1")
    label = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h0", "box_id", "text"))), lambda b: F.trim(b["text"])), " ")
    return strips.join(named.groupBy(*PAGE, F.col("span").alias("band")).agg(label.alias("label")), [*PAGE, "band"])


def slice_boxes(boxes: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, page, band, text, y, box_id): the pieces of boxes cut along the strips.

    Lines of a box become rows; several numbers in a number column become rows; a box across strips deals its words out
    from left to right, or stays whole in the first where it has too few.
    """
    return _sliced(boxes.join(_strips(bounds), list(PAGE)))


def _strips(bounds: DataFrame) -> DataFrame:
    """(doc_id, page, strips): a row a page; what a strip's label says is worked out here, not for each box."""
    label = F.col("label")
    one = F.struct("band", "b0", "b1", F.coalesce(S.is_numeric_header("label"), F.lit(False)).alias("numeric"), F.coalesce(label == "", F.lit(False)).alias("blank"))
    return bounds.groupBy(*PAGE).agg(F.array_sort(F.collect_list(one)).alias("strips"))


def _sliced(near: DataFrame) -> DataFrame:
    """``slice_boxes`` of boxes with their page's strips."""
    lines = F.filter(F.transform(F.split("text", r"[\n\r]+"), lambda t: F.trim(t)), lambda t: t != "")
    near = near.where(F.trim("text") != "").withColumn("lines", F.when(F.col("text").rlike(r"[\n\r]"), lines).otherwise(F.array(F.trim("text")))).where(F.size("lines") > 0)
    at = lambda b: F.struct(b["band"].alias("band"), b["numeric"].alias("numeric"), b["blank"].alias("blank")).alias("at")
    touched = F.transform(F.filter("strips", lambda b: (F.col("x1") > b["b0"]) & (F.col("x0") < b["b1"])), lambda b: b["band"])
    widest = F.array_max(F.transform("strips", lambda b: F.struct((F.least("x1", b["b1"]) - F.greatest("x0", b["b0"])).alias("lap"), (-b["band"]).alias("first"), at(b))))
    nearest = F.array_min(F.transform("strips", lambda b: F.struct(F.abs(_cx() - (b["b0"] + b["b1"]) / 2).alias("away"), b["band"].alias("first"), at(b))))
    each = near.withColumn("touched", touched)
    each = each.withColumn("head", F.when(F.size("touched") > 0, widest["at"]).otherwise(nearest["at"]))
    each = each.withColumns({"primary": F.col("head.band"), "spanned": F.when(F.size("touched") > 0, F.col("touched")).otherwise(F.array("head.band")), "h": F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))})
    numeric, first = F.col("head.numeric"), F.get("lines", F.lit(0))
    each = each.withColumns({"values": F.when(numeric | F.col("head.blank"), S.split_numbers(first)), "words": F.when(F.size("spanned") > 1, F.split(first, r"\s+"))})
    stacked = (F.size("values") > 1) & ((F.size("spanned") == 1) | (F.size("values") > F.size("spanned")) | numeric)
    piece = lambda band, text, y: F.struct(band.alias("band"), text.alias("text"), y.alias("y"))
    down = lambda items, band: F.transform(items, lambda t, i: piece(band, t, F.col("y0") + (i + 0.5) * F.col("h") / F.size(items)))
    across = F.transform("spanned", lambda b, i: piece(b, F.get("words", i), _cy()))
    pieces = F.when(F.size("lines") > 1, down(F.col("lines"), F.col("spanned")[0])).when(stacked, down(F.col("values"), F.col("primary"))).when((F.size("spanned") > 1) & (F.size("words") >= F.size("spanned")), across).otherwise(F.array(piece(F.col("spanned")[0], F.col("lines")[0], _cy())))
    return each.select(*PAGE, "box_id", F.inline(pieces))


def nearest_free(rows: Sequence[float], ys: Sequence[float], reach: float) -> list[int | None]:
    """For each of ``ys`` the row that takes it, or None: each row, from the top, takes the nearest free one within ``reach``, the upper in a tie. Both are in order."""
    values = sorted(set(ys))
    at = [bisect_left(ys, v) for v in values]
    end = [*at[1:], len(ys)]
    # Where the next value with a free piece stands on either side; places count from 1, with nothing at both ends.
    up, down = list(range(len(values) + 2)), list(range(len(values) + 2))

    def free(to: list[int], k: int) -> int:
        while to[k] != k:
            to[k] = to[to[k]]
            k = to[k]
        return k

    out: list[int | None] = [None] * len(ys)
    for i, y in enumerate(rows):
        k = bisect_right(values, y)
        away, j = min(((abs(values[j - 1] - y), j) for j in (free(up, k), free(down, k + 1)) if 0 < j <= len(values)), default=(reach, 0))
        if j and away <= reach:
            out[at[j - 1]] = i
            at[j - 1] += 1
            if at[j - 1] == end[j - 1]:
                up[j], down[j] = j - 1, j + 1
    return out


def snap_rows(pieces: DataFrame, heights: DataFrame, dealt: bool = False) -> DataFrame:
    """(doc_id, page, line, band, cell): pieces placed on the rows of the fullest strip; line is null for pieces that no row takes.

    A strip with as many pieces as there are rows, starting near the first, is read in order. In others each row, from
    the top, takes the nearest free piece within reach; as that depends on the choices before, only such strips go to
    Python, by batches of any pages. Pieces at one height stand in the order of their texts.
    ``dealt`` says that pieces already lie by page.
    """

    @F.pandas_udf("array<int>")
    def taken(rows: pd.Series, ys: pd.Series, reach: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else nearest_free(r.tolist(), y.tolist(), f) for r, y, f in zip(rows, ys, reach, strict=True)], dtype=object)

    # Dealt out by page once: strips and what a page has in common follow from that.
    cells = F.array_sort(F.collect_list(F.struct("y", "text")))
    pieces = pieces.select(*PAGE, "band", "y", "text")
    strips = (pieces if dealt else pieces.repartition(*PAGE)).groupBy(*PAGE, "band").agg(cells.alias("cells")).withColumn("n", F.size("cells"))
    back = F.max_by(F.struct("band", F.col("cells.y").alias("y")), F.struct("n", -F.col("band"))).over(W.partitionBy(*PAGE))
    strips = strips.withColumn("back", back).join(heights.select(*PAGE, "median"), list(PAGE))
    first, rows = F.col("back.y")[0], F.size("back.y")
    pitch = F.when(rows > 1, (F.element_at("back.y", -1) - first) / (rows - 1)).otherwise(F.col("median"))
    strips = strips.withColumn("reach", F.greatest(F.lit(1.0), F.col("median") * K.SNAP_TOLERANCE, pitch * K.SNAP_TOLERANCE))
    near = (F.col("band") == F.col("back.band")) | (F.abs(F.col("cells")[0]["y"] - first) <= 3 * F.col("reach"))
    strips = strips.withColumn("ordered", (F.col("n") == rows) & near)
    other = lambda c: F.when(~F.col("ordered"), c)
    strips = strips.withColumn("placed", taken(other(F.col("back.y")), other(F.col("cells.y")), F.col("reach")))
    each = strips.select(*PAGE, "band", "ordered", "placed", F.posexplode("cells").alias("i", "piece"))
    line = F.when(F.col("ordered"), F.col("i")).otherwise(F.get("placed", F.col("i")))
    return each.select(*PAGE, line.alias("line"), F.col("band").cast("int").alias("band"), F.col("piece.text").alias("cell"))


def template_cells(boxes: DataFrame, labels: Sequence[str] | DataFrame, suppliers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, unplaced pieces) of pages whose header resembles their layout's labels; row 0 is the header. Other pages give no cells.

    ``labels`` is one layout for all pages, or a table (supplier, label) of any number of layouts, and ``suppliers``
    (doc_id, supplier) tells whose each document is; documents that it doesn't name give no cells.
    """
    if suppliers is None:
        boxes = boxes.withColumn("supplier", F.lit(""))
        labels = boxes.sparkSession.createDataFrame([("", n) for n in labels], "supplier string, label string")
    else:
        boxes = boxes.join(suppliers.select("doc_id", "supplier"), "doc_id")
    height = F.when(F.coalesce("text", F.lit("")) != "", F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")))
    boxes = settle(_marked(with_page_width(boxes).withColumn("median", F.median(height).over(W.partitionBy(*PAGE))), labels), "boxes")
    header = settle(_header_boxes(boxes, labels), "header")
    bounds = settle(column_bounds(header).withColumn("m", F.count(F.lit(1)).over(W.partitionBy(*PAGE))).where("m >= 2").drop("m"), "bounds")
    # One row a page tells its boxes what they need, and they are dealt out by page once.
    tops = header.groupBy(*PAGE).agg(F.max("y1").alias("floor"), F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    pages = _strips(bounds).join(tops, list(PAGE))
    body = boxes.select(*PAGE, "box_id", "text", "x0", "y0", "x1", "y1").repartition(*PAGE).join(pages, list(PAGE)).where((_cy() >= F.col("floor")) & ~_cy().between(F.col("lo"), F.col("hi")))
    heights = header.groupBy(*PAGE).agg(F.max("median").alias("median"))
    placed = settle(snap_rows(_sliced(body), heights, dealt=True), "placed")
    grid = placed.where("line is not null").select("doc_id", "page", (F.col("line") + 1).alias("row_idx"), "band", "cell")
    rows = grid.select(*PAGE, "row_idx").distinct().unionByName(bounds.select(*PAGE, F.lit(0).alias("row_idx")).distinct())
    full = rows.join(bounds.select(*PAGE, "band", "label"), list(PAGE)).join(grid, [*PAGE, "row_idx", "band"], "left")
    cell = F.when(F.col("row_idx") == 0, F.col("label")).otherwise(F.coalesce("cell", F.lit("")))
    return full.select("doc_id", F.col("page").alias("table_id"), "row_idx", F.col("band").alias("col_idx"), cell.alias("cell")), placed.where("line is null").select("doc_id", "page", "band", "cell")


def rotate(boxes: DataFrame, page_height: Column, clockwise: bool = True) -> DataFrame:
    """Boxes of a page turned by a quarter: (x, y) becomes (H - y, x), or (y, W - x) the other way."""
    w = F.col("page_width")
    if clockwise:
        new = {"x0": page_height - F.col("y1"), "x1": page_height - F.col("y0"), "y0": F.col("x0"), "y1": F.col("x1")}
    else:
        new = {"x0": F.col("y0"), "x1": F.col("y1"), "y0": w - F.col("x1"), "y1": w - F.col("x0")}
    return boxes.select(*[c for c in boxes.columns if c not in (*new, "page_width")], *[v.alias(k) for k, v in new.items()], page_height.alias("page_width"))


#: How a page may lie; the first is the page as it is.
TURNS = ("none", "clockwise", "counterclockwise")


def orientations(boxes: DataFrame, page_height: Column, layouts: DataFrame) -> DataFrame:
    """(doc_id, page, turn, hits, below, regular): for each of ``TURNS``, how much the page would look like a table.

    hits: the most labels that boxes of one row resemble, of ``layouts`` (supplier, label; of the document's own supplier
    where ``boxes`` has that column, else of any). below: the share of boxes under that row less that above it. regular:
    the share of boxes that are wider than tall and share a row with another.
    """
    boxes = with_page_width(boxes)
    if "supplier" not in boxes.columns:
        boxes, layouts = boxes.withColumn("supplier", F.lit("")), layouts.select(F.lit("").alias("supplier"), "label")
    boxes = settle(with_labels(boxes, layouts), "labelled")
    # A turn counts as a page of its own, so that all are looked at in one plan.
    turned = [boxes, rotate(boxes, page_height), rotate(boxes, page_height, clockwise=False)]
    columns = boxes.columns
    every = None
    for i, one in enumerate(turned):
        one = one.select(*columns).withColumn("page", F.col("page") * len(TURNS) + i)
        every = one if every is None else every.unionByName(one)
    lines = rows_of(every).groupBy(*PAGE, "line").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("labels"), F.count_if(F.col("x1") - F.col("x0") > F.col("y1") - F.col("y0")).alias("wide"))
    page = W.partitionBy(*PAGE)
    head = F.max(F.struct("labels", (-F.col("line")).alias("at"))).over(page)
    lines = lines.withColumn("head", head)
    at = -F.col("head.at")
    seen = lines.groupBy(*PAGE).agg(F.max("head.labels").alias("hits"), F.sum(F.when(F.col("line") > at, F.col("n")).when(F.col("line") < at, -F.col("n")).otherwise(0)).alias("below"), F.sum(F.when(F.col("n") > 1, F.col("wide")).otherwise(0)).alias("regular"), F.sum("n").alias("n"))
    return seen.select("doc_id", F.floor(F.col("page") / len(TURNS)).cast("int").alias("page"), F.element_at(F.array(*map(F.lit, TURNS)), (F.col("page") % len(TURNS) + 1).cast("int")).alias("turn"), "hits", F.when(F.col("hits") > 0, F.col("below") / F.col("n")).otherwise(0.0).alias("below"), (F.col("regular") / F.col("n")).alias("regular"))


def upright(boxes: DataFrame, page_height: Column, layouts: DataFrame) -> DataFrame:
    """``boxes`` with every page turned the way that looks most like a table, and turn; a page that has no single best way stays as it is.

    More labels in a row win, then more boxes below them, then more regular rows.
    """
    boxes = settle(with_page_width(boxes).withColumn("__height", page_height.cast("double")), "boxes")
    score = F.struct("hits", F.round("below", 6).alias("below"), F.round("regular", 6).alias("regular"))
    scored = orientations(boxes, F.col("__height"), layouts).withColumn("score", score)
    best = scored.withColumn("top", F.max("score").over(W.partitionBy(*PAGE))).where(F.col("score") == F.col("top")).groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("turn"))
    chosen = boxes.join(best.select(*PAGE, F.when(F.col("n") == 1, F.col("turn")).otherwise(TURNS[0]).alias("turn")), list(PAGE), "left").withColumn("turn", F.coalesce("turn", F.lit(TURNS[0])))
    columns = [*[c for c in boxes.columns if c != "__height"], "turn"]
    out = chosen.where(F.col("turn") == TURNS[0]).select(*columns)
    for turn in TURNS[1:]:
        out = out.unionByName(rotate(chosen.where(F.col("turn") == turn), F.col("__height"), turn == TURNS[1]).select(*columns))
    return out
