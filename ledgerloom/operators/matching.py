"""Many fixed texts looked for in many documents: one Aho-Corasick automaton, each document read once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.store import settle

#: Characters of identifiers in one automaton: some 100 MB a Python worker. More are dealt over several.
MAX_CHARACTERS = 2_000_000

_numbers = count()
_built: dict[int, tuple[ahocorasick.Automaton, list[str]]] = {}


def _automaton(number: int, shipped: Broadcast) -> tuple[ahocorasick.Automaton, list[str]]:
    """A worker builds an automaton once and keeps the last one."""
    if number not in _built:
        _built.clear()
        machine, always = ahocorasick.Automaton(), []
        for mark, owners in shipped.value:
            if mark:
                machine.add_word(mark, (mark, owners))
            else:
                always += owners
        if len(machine):
            machine.make_automaton()
        _built[number] = machine, always
    return _built[number]


def _hits(texts: DataFrame, marks: list[tuple[str, list[int]]]) -> DataFrame:
    """``texts`` (row, low) as (row, found): how many of each owner's identifiers stand in ``low``."""
    shipped, number = texts.sparkSession.sparkContext.broadcast(marks), next(_numbers)
    shape = pa.list_(pa.struct([("owner", pa.int64()), ("hits", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, always = _automaton(number, shipped)
        for batch in batches:
            found = []
            for text in batch.column("low"):
                low, hits = text.as_py() or "", dict.fromkeys(always, 0)
                for owner in always:
                    hits[owner] += 1
                for mark, owners in {m: o for _, (m, o) in machine.iter(low)}.items() if len(machine) else ():
                    for owner in owners:
                        hits[owner] = hits.get(owner, 0) + 1
                found.append([{"owner": o, "hits": n} for o, n in sorted(hits.items())])
            yield pa.record_batch([batch.column("row"), pa.array(found, shape)], ["row", "found"])

    return texts.mapInArrow(run, f"row {texts.schema['row'].dataType.simpleString()}, found array<struct<owner:bigint,hits:bigint>>")


def supplier_hits(texts: DataFrame, identifiers: DataFrame, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """(doc_id, decl_order, hits) of the suppliers some of whose identifiers stand in a document's text, in either case.

    ``texts`` has (doc_id, text), a row a document, ``identifiers`` (supplier, decl_order, identifier). An identifier that
    a supplier lists twice counts twice, one of several suppliers for each; an empty one stands in every text. What an
    automaton holds is bounded: more identifiers than ``max_characters`` are dealt over several, which all texts pass.
    """
    marks = identifiers.select(F.lower(F.coalesce("identifier", F.lit(""))).alias("mark"), F.col("decl_order").cast("bigint").alias("owner"))
    marks = marks.groupBy("mark").agg(F.array_sort(F.collect_list("owner")).alias("owners"))
    size = marks.agg(F.sum(F.length("mark") + F.size("owners"))).first()[0] or 0
    parts = max(1, -(-size // max_characters))
    if parts > 1:
        marks = settle(marks, "identifiers")
    rows = texts.select(F.struct("doc_id").alias("row"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = None
    for part in range(parts):
        held = [(r.mark, list(r.owners)) for r in marks.where(F.pmod(F.xxhash64("mark"), F.lit(parts)) == part).collect()]
        one = _hits(rows, held).select("row.doc_id", F.inline("found").alias("decl_order", "hits"))
        found = one if found is None else found.unionAll(one)
    return found if parts == 1 else found.groupBy("doc_id", "decl_order").agg(F.sum("hits").alias("hits"))


def detect_suppliers(texts: DataFrame, identifiers: DataFrame, max_characters: int = MAX_CHARACTERS) -> DataFrame:
    """(doc_id, supplier): for each document the supplier with the most identifiers in its text, the first declared in a tie; none, no row."""
    hits = supplier_hits(texts, identifiers, max_characters)
    best = hits.groupBy("doc_id").agg(F.max(F.struct("hits", (-F.col("decl_order")).alias("order"))).alias("best"))
    names = identifiers.groupBy(F.col("decl_order").cast("bigint").alias("owner")).agg(F.min("supplier").alias("supplier"))
    return best.select("doc_id", (-F.col("best.order")).alias("owner")).join(names, "owner").select("doc_id", "supplier")
