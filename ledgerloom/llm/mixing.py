"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Raking scales the cells' token weights until the marginals of all
three dimensions meet their targets; a document of a cell is then kept with the probability that brings the cell's
expected tokens to its raked weight, decided by a hash of its id. Only the cells' token sums leave the executors, and
their number is checked: more than MAX_CELLS are raked as a table by grouped sums instead, to the same targets.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import topics
from ledgerloom.llm.shared import documents, materialize, slices

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: the shares of sources and languages, and of topics within a language, raised to this power (1 keeps them, 0 evens them out).
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.5}
#: Expected share of the tokens that the sample holds.
BUDGET = 0.6
MAX_CELLS = 200_000
#: Raking ends at this distance or after so many rounds, whether cells are collected or raked as a table.
ROUNDS, TOLERANCE = 300, 1e-7
#: Part of its documents that a default target may ask of a value, so that cells inside it have room.
ROOM = 0.9
#: Raking ends where a round leaves more than this part of the distance: the targets can't be met together.
STALLED = 0.9999
#: A marginal that stays farther than this from its target is reported.
MISSED = 1e-4
SEED = 20240229
Targets = Mapping[str, Mapping[object, float]]


def rake(cells: pd.DataFrame, targets: Targets, rounds: int = ROUNDS, tolerance: float = TOLERANCE, budget: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights of the cells, summing to 1, whose marginals meet ``targets`` as nearly as the empty cells allow, and how far the farthest is off.

    ``cells`` has the targets' columns and tokens. Values that a target doesn't name, and cells without tokens, get 0. With a
    ``budget``, the part of all tokens that a sample is to hold, no weight is more than its cell's documents can fill: each
    round ends by clipping, so that the sample follows the weights.
    """
    weight = cells["tokens"].to_numpy(float)
    most = weight / (budget * weight.sum()) if budget and weight.sum() else np.full(len(weight), np.inf)
    weight = weight / weight.sum() if weight.sum() else weight
    codes, wanted = {}, {}
    for d, target in targets.items():
        codes[d], values = pd.factorize(cells[d], use_na_sentinel=False)
        want = np.array([target.get(None if pd.isna(v) else v, 0.0) for v in values], float)
        wanted[d] = want / want.sum() if want.sum() else want

    def farthest() -> float:
        return max((float(np.abs(np.bincount(code, weight, len(wanted[d])) - wanted[d]).max(initial=0.0)) for d, code in codes.items()), default=0.0)

    before = np.inf
    for _ in range(rounds):
        off = farthest()
        if off < tolerance or off > STALLED * before:
            break
        before = off
        for d, code in codes.items():
            have = np.bincount(code, weight, len(wanted[d])).astype(float)  # integers where there are no cells
            weight = weight * np.divide(wanted[d], have, out=np.zeros_like(have), where=have > 0)[code]
        weight = np.minimum(weight, most)
    off = farthest()
    # What clipping took for good goes to all alike, so that weights stay shares.
    return weight / weight.sum() if budget and weight.sum() else weight, off


def rake_table(cells: DataFrame, targets: Mapping[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE, budget: float = 0.0) -> tuple[DataFrame, float]:
    """``rake`` for cells that are too many to collect: adds weight to ``cells``. A target is a table of the dimension and share.

    A round is one sum and one join a dimension, written to the shared folder; nothing but the farthest distance is collected.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = materialize(cells.withColumn("weight", F.col("tokens") / F.lit(max(total, 1))), "raked")
    wanted = {d: materialize(t.withColumn("share", F.col("share") / F.lit(t.agg(F.sum("share")).first()[0] or 1.0)), "target") for d, t in targets.items()}
    off = before = np.inf
    for number in range(rounds + 1):
        off, before = 0.0, off
        for d, t in wanted.items():
            have = now.groupBy(d).agg(F.sum("weight").alias("__have"))
            both = have.join(t.select(F.col(d).alias("__value"), "share"), F.col(d).eqNullSafe(F.col("__value")), "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
            off = max(off, both.agg(F.max(F.abs(F.col("__have") - F.col("share")))).first()[0] or 0.0)
        if off < tolerance or number == rounds or off > STALLED * before:
            break
        for d, t in wanted.items():
            have = now.groupBy(d).agg(F.sum("weight").alias("__have"))
            both = have.join(t.select(F.col(d).alias("__value"), "share"), F.col(d).eqNullSafe(F.col("__value")), "left")
            scale = both.select(F.col(d).alias("__of"), F.when(F.col("__have") > 0, F.coalesce("share", F.lit(0.0)) / F.col("__have")).otherwise(0.0).alias("__scale"))
            scaled = now.join(scale, F.col(d).eqNullSafe(F.col("__of"))).withColumn("weight", F.col("weight") * F.col("__scale"))
            now = materialize(scaled.select(*cells.columns, "weight"), "raked")
        if budget:
            now = now.withColumn("weight", F.least("weight", F.col("tokens") / F.lit(budget * max(total, 1))))
    if budget:
        now = now.withColumn("weight", F.col("weight") / F.lit(now.agg(F.sum("weight")).first()[0] or 1.0))
    return now, off


def probabilities(weight: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Inclusion probabilities in proportion to weight over tokens, with ``budget`` of all tokens expected.

    Cells that would need more than all their documents keep all; the others make up for them.
    """
    ratio = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    p, want = np.zeros_like(ratio), budget * tokens.sum()
    full = np.zeros(len(ratio), bool)
    while True:
        mass = (ratio * tokens)[~full].sum()
        p = np.where(full, 1.0, ratio * max(want - tokens[full].sum(), 0.0) / mass if mass > 0 else 0.0)
        over = (p > 1) & ~full
        if not over.any():
            return p
        full |= over


def probability_table(raked: DataFrame, budget: float) -> DataFrame:
    """``probabilities`` for a table of cells with tokens and weight."""
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    now = raked.withColumns({"__ratio": F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0), "__full": F.lit(False)})
    while True:
        mass, taken = now.agg(F.sum(F.when(~F.col("__full"), F.col("__ratio") * F.col("tokens"))), F.coalesce(F.sum(F.when(F.col("__full"), F.col("tokens"))), F.lit(0))).first()
        scale = max(budget * total - taken, 0.0) / mass if mass else 0.0
        over = (F.col("__ratio") * scale > 1) & ~F.col("__full")
        if now.where(over).isEmpty():
            p = F.when(F.col("tokens") <= 0, 1.0).when(F.col("__full"), 1.0).otherwise(F.col("__ratio") * scale)
            return now.withColumn("probability", p).drop("__ratio", "__full")
        now = materialize(now.withColumn("__full", F.col("__full") | over), "full_cells")


def target_tables(cells: DataFrame, budget: float = BUDGET) -> dict[str, DataFrame]:
    """The default targets, as tables (dimension, share) that add up to 1: shares of the tokens, tempered as far as the budget goes.

    Topics are tempered within their language, so that the targets of topics and languages never contradict each other. A
    sample can't hold more of a value than there is: where the tempered shares ask for more than ROOM of a value's tokens,
    all targets move back towards the shares as they are, by one part for all, which keeps them in agreement.
    """
    known = cells.where("tokens > 0")
    total = F.sum("tokens").cast("double")
    whole = known.agg(total).first()[0] or 1.0
    tempered = lambda of, d: F.pow(of, F.lit(TEMPERATURE[d]))
    norm = {}
    for d in ("source", "lang"):
        t = known.groupBy(d).agg(total.alias("have")).select(d, (F.col("have") / whole).alias("have"), tempered(F.col("have"), d).alias("part"))
        norm[d] = materialize(t.crossJoin(F.broadcast(t.agg(F.sum("part").alias("__all")))).select(d, "have", (F.col("part") / F.col("__all")).alias("share")), "target")  # one row
    pairs = known.groupBy("lang", "topic").agg((total / whole).alias("have"), tempered(total, "topic").alias("__part"))
    parts = pairs.groupBy(F.col("lang").alias("__l")).agg(F.sum("__part").alias("__all"))
    lang = norm["lang"].select(F.col("lang").alias("__g"), F.col("share").alias("__share"))
    joined = pairs.join(parts, F.col("lang").eqNullSafe(F.col("__l"))).join(lang, F.col("lang").eqNullSafe(F.col("__g")))
    norm["topic"] = materialize(joined.groupBy("topic").agg(F.sum("have").alias("have"), F.sum(F.col("__share") * F.col("__part") / F.col("__all")).alias("share")), "target")
    most = F.col("have") * (ROOM / budget)
    back = F.when(F.col("share") > most, (F.col("share") - most) / (F.col("share") - F.col("have"))).otherwise(0.0)
    a = min(1.0, max(t.agg(F.max(back)).first()[0] or 0.0 for t in norm.values()))
    return {d: t.select(d, (F.col("share") * (1 - a) + F.col("have") * a).alias("share")) for d, t in norm.items()}


def draw(key: str, mark: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id (and, for rows without one, ``mark``): repeated rows fare alike, and a rerun draws the same sample."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(mark), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def _mark(df: DataFrame, key: str = "doc_id") -> Column:
    """Tells rows without an id apart, by their texts."""
    return F.when(F.col(key).isNull(), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")


def calibrate(topical: DataFrame, targets: Targets | None = None, budget: float = BUDGET, max_cells: int = MAX_CELLS) -> DataFrame:
    """One row a cell: source, lang, topic, tokens, weight, probability. ``topical`` has the dimensions and tokens.

    ``targets`` names shares by value for any of the dimensions, all of them by default. Documents without tokens count
    for nothing in a cell's sum; a cell of such documents alone keeps them all. Weights are raked within what each cell can
    fill at this ``budget``, so the sample's expected shares are theirs. Targets that no such weights can meet (they
    contradict each other, cells are empty or too small) are reported by a warning; ``marginals`` shows all that is reached.
    """
    spark = topical.sparkSession
    cells = materialize(topical.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    kinds = {f.name: f.dataType for f in cells.schema}
    if targets is None:
        tables = target_tables(cells, budget)
    else:
        tables = {d: spark.createDataFrame([(k, float(v)) for k, v in t.items()], f"{d} {kinds[d].simpleString()}, share double") for d, t in targets.items()}
    if cells.limit(max_cells + 1).count() > max_cells:
        raked, off = rake_table(cells, tables, budget=budget)
        out = materialize(probability_table(raked, budget), "calibrated")
    else:
        frame = cells.toPandas().sort_values(list(DIMENSIONS), kind="stable", na_position="first").reset_index(drop=True)
        wanted = targets or {d: {r[0]: r[1] for r in t.collect()} for d, t in tables.items()}
        tokens = frame["tokens"].to_numpy(float)
        weight, off = rake(frame, wanted, budget=budget)
        chance = np.where(tokens > 0, probabilities(weight, tokens, budget), 1.0)
        rows = [(None if pd.isna(s) else s, None if pd.isna(g) else g, int(t), int(n), float(w), float(p)) for s, g, t, n, w, p in zip(frame["source"], frame["lang"], frame["topic"], frame["tokens"], weight, chance, strict=True)]
        out = spark.createDataFrame(rows, f"source {kinds['source'].simpleString()}, lang {kinds['lang'].simpleString()}, topic int, tokens long, weight double, probability double")
    if off > MISSED:
        warnings.warn(f"raking leaves a marginal {off:.2g} from its target", stacklevel=2)
    return out


def marginals(cells: DataFrame) -> DataFrame:
    """(dimension, value, tokens, raked, expected): shares of the tokens before, of the raked weights, and of what sampling is expected to keep."""
    total = cells.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("e"))
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("raked"), F.sum(F.col("tokens") * F.col("probability")).alias("expected")) for d in DIMENSIONS]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2]).crossJoin(F.broadcast(total))  # one row
    return both.select("dimension", "value", (F.col("tokens") / F.col("t")).alias("tokens"), "raked", (F.col("expected") / F.col("e")).alias("expected"))


def sampled(topical: DataFrame, cells: DataFrame, key: str = "doc_id", mark: str = "__mark", max_cells: int = MAX_CELLS) -> DataFrame:
    """``topical`` with weight, probability and selected (boolean) of every row; ``cells`` is broadcast if it has few rows."""
    c = cells.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "weight", "probability")
    c = F.broadcast(c) if cells.limit(max_cells + 1).count() <= max_cells else c
    joined = topical.join(c, [F.col(d).eqNullSafe(F.col(f"__{d}")) for d in DIMENSIONS]).drop(*[f"__{d}" for d in DIMENSIONS])
    return joined.withColumn("selected", draw(key, mark) < F.col("probability"))


def _topical(docs: DataFrame) -> tuple[DataFrame, topics.Topics]:
    """(doc_id, source, lang, __mark, tokens, topic) of all rows, and the topics."""
    rows = docs.select("doc_id", "source", "lang", "text", _mark(docs).alias("__mark"))
    termed = materialize(topics.with_terms(rows, ["doc_id", "source", "lang", "__mark"]), "terms")
    found = topics.fit(termed)
    return topics.with_topics(termed, found), found


def mix(docs: DataFrame, targets: Targets | None = None, budget: float = BUDGET) -> DataFrame:
    """The sampled rows of ``docs`` (doc_id, text, source, lang and any others), with their own columns, whatever those are called.

    Null and empty texts have topic 0 and no tokens; rows of one id are kept or left out together where they share a cell.
    """
    topical, found = _topical(docs)
    cells = calibrate(topical, targets, budget)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = own.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "row.text", 4 << 20, topics.ROWS):
                text = part.column("row").field("text").fill_null("")
                row, term, count, words = topics.terms_of(text)
                yield pa.record_batch([part.column("row"), pa.array(found.of(row, term, count, len(words)), pa.int32())], ["row", "topic"])

    rows = own.mapInArrow(run, f"row {kind}, topic int").select("row", "topic", F.col("row.source").alias("source"), F.col("row.lang").alias("lang"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    rows = rows.withColumn("__mark", _mark(rows)).drop("text")
    return sampled(rows, cells).where("selected").select("row.*")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, the cell's raked weight and inclusion probability, and whether the sample holds it."""
    topical = materialize(_topical(documents(spark, sf_dir))[0], "topical")
    return sampled(topical, calibrate(topical)).select("doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "selected")
