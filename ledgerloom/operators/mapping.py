"""Which standard column a header means, and which supplier a document comes from."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import constants as K
from ledgerloom.functions import scalars as S
from ledgerloom.functions.similarity import Scorer, best_match, similarity
from ledgerloom.sources.rules import Rules
from ledgerloom.sources.store import settle, small

_ARABIC = re.compile(K.ARABIC)


def normalized(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", (text or "").lower()).split())


def alias_pairs(columns: Iterable[str] = K.STANDARD_COLUMNS) -> list[tuple[str, str]]:
    """(standard column, normalized alias) in the columns' order; Arabic aliases also in display order."""
    out: dict[tuple[str, str], None] = {}
    for column in columns:
        for alias in [*K.ALIASES.get(column, []), column]:
            for form in [alias, alias[::-1]] if _ARABIC.search(alias) else [alias]:
                if normalized(form):
                    out[column, normalized(form)] = None
    return list(out)


def map_columns(headers: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_id"), columns: Iterable[str] = K.STANDARD_COLUMNS, threshold: float = K.FUZZY_ACCEPT, scorer: Scorer = similarity) -> DataFrame:
    """``headers`` (keys, col_idx, header) with standard_column (null: unmapped) and score.

    First, headers that imply a currency claim its column, one each, in header order. Then each other header has one best
    column; the first header of a column that isn't claimed takes it. A header never falls back to a second choice.
    """
    columns = list(columns)
    # All windows, and what a caller groups by table, share this exchange; by their own keys they would ask for one each.
    found = headers.repartition(*keys).withColumn("currency", S.header_currency("header"))
    found = found.withColumn("currency", F.when(F.col("currency").isin(*columns), F.col("currency")))
    first = F.row_number().over(W.partitionBy(*keys, "currency").orderBy("col_idx"))
    found = found.withColumn("by_currency", F.when(F.col("currency").isNotNull() & (first == 1) & (F.col("header") != ""), F.col("currency")))
    # Scores are worked out once for each distinct header. "Date" stands in nearly every table: the scores go to the tables, not the tables to them.
    distinct = settle(found.select("header").distinct().withColumn("best", best_match(S.normalize_header("header"), alias_pairs(columns), scorer)), "scores")
    found = found.join(small(distinct), "header", "left")
    taken = F.collect_set("by_currency").over(W.partitionBy(*keys))
    open_for = F.col("by_currency").isNull() & (F.col("best.score") >= threshold) & ~F.array_contains("taken", F.col("best.name"))
    found = found.withColumn("taken", taken).withColumn("wanted", F.when(open_for, F.col("best.name")))
    claim = F.row_number().over(W.partitionBy(*keys, "wanted").orderBy("col_idx"))
    by_name = F.when(F.col("wanted").isNotNull() & (claim == 1), F.col("wanted"))
    score = F.when(F.col("by_currency").isNotNull(), 1.0).otherwise(F.col("best.score"))
    return found.withColumn("standard_column", F.coalesce("by_currency", by_name)).withColumn("score", score).select(*headers.columns, "standard_column", "score")


def resolve_keys(headers: list[str], wanted: list[str], threshold: float = K.PROFILE_KEY_MATCH, scorer: Scorer = similarity) -> list[int]:
    """For each wanted header, in order, the place among ``headers`` that it claims, or -1.

    An equal header that is free wins, else the closest free one from ``threshold`` on. Claims depend on the ones before.
    """
    taken: set[int] = set()
    out = []
    for key in wanted:
        at = next((i for i, h in enumerate(headers) if h == key and i not in taken), -1)
        if at < 0 and normalized(key):
            scored = [(scorer(normalized(key), normalized(h)), -i) for i, h in enumerate(headers) if i not in taken]
            top, place = max(scored, default=(0.0, 0))
            at = -place if top >= threshold else -1
        if at >= 0:
            taken.add(at)
        out.append(at)
    return out


def map_profile(headers: DataFrame, rules: Rules, supplier: str = "supplier", keys: tuple[str, ...] = ("doc_id", "table_id"), scorer: Scorer = similarity) -> DataFrame:
    """(keys, supplier, col_idx, header, standard_column, note_label, coverage) by each table's own supplier profile.

    Columns feed a standard column or, under a label, the notes; a second source of one target goes to the notes. The
    coverage is the share of the profile's columns that resolved.
    """
    profiles = {k: (list(p.columns.items()), list(p.notes.items())) for k, p in rules.suppliers.items()}

    @F.pandas_udf("array<struct<place:int,standard_column:string,note_label:string,coverage:double>>")
    def resolve(who: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for key, heads in zip(who, names, strict=True):
            columns, notes = profiles.get(key, ([], []))
            at = resolve_keys(list(heads), [c for c, _ in columns] + [n for n, _ in notes], scorer=scorer)
            hits = sum(a >= 0 for a in at[: len(columns)]) / len(columns) if columns else 0.0
            claimed, found = set(), []
            for a, (head, target) in zip(at, columns, strict=False):
                if a >= 0:
                    found.append((a, None if target in claimed else target, head if target in claimed else None, hits))
                    claimed.add(target)
            found += [(a, None, label, hits) for a, (_, label) in zip(at[len(columns) :], notes, strict=True) if a >= 0]
            out.append([dict(zip(("place", "standard_column", "note_label", "coverage"), f, strict=True)) for f in found])
        return pd.Series(out)

    tables = headers.groupBy(*keys, supplier).agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("heads"))
    found = tables.withColumn("hit", F.explode(resolve(F.col(supplier), F.col("heads.header")))).withColumn("head", F.col("heads")[F.col("hit.place")])
    return found.select(*keys, supplier, "head.*", "hit.standard_column", "hit.note_label", "hit.coverage")


def profile_fits(mapped: DataFrame, keys: tuple[str, ...] = ("doc_id", "table_id"), least: float = K.PROFILE_COVERAGE) -> DataFrame:
    """(keys, coverage, fits) of ``map_profile``'s tables."""
    return mapped.groupBy(*keys).agg(F.max("coverage").alias("coverage")).withColumn("fits", F.col("coverage") >= least)


def supplier_scores(text: Column, identifiers: Mapping[str, list[str]]) -> Column:
    """array<struct<hits, order, supplier>>: how many of each supplier's identifiers the text contains, in either case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = lambda name, marks, k: F.struct(sum((low.contains(m.lower()).cast("int") for m in marks), F.lit(0)).alias("hits"), F.lit(-k).alias("order"), F.lit(name).alias("supplier"))
    return F.array(*[one(name, marks, k) for k, (name, marks) in enumerate(identifiers.items())])


def detect_supplier(text: Column, identifiers: Mapping[str, list[str]]) -> Column:
    """The supplier with the most identifiers in the text, the first declared in a tie; null without any."""
    if not identifiers:
        return F.lit(None).cast("string")
    best = F.array_max(supplier_scores(text, identifiers))
    return F.when(best["hits"] > 0, best["supplier"])


def supplier_label(key: Column) -> Column:
    return F.when(F.coalesce(key, F.lit("auto_detected")) != "auto_detected", F.concat(key, F.lit(" (profile)"))).otherwise("Unknown (Smart Fallback)")


def choose_engine(engine: Column, scanned: Column) -> Column:
    """struct<value, error>: ocr or text, as asked for or, for ``auto``, as the document needs; anything else has an error instead of a value."""
    asked = F.coalesce(engine, F.lit("auto"))
    value = F.when(asked == "auto", F.when(scanned, "ocr").otherwise("text")).when(asked.isin("ocr", "text"), asked)
    return F.struct(value.alias("value"), F.when(value.isNull(), F.concat(F.lit("unknown engine: "), asked)).alias("error"))
