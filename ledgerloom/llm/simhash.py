"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ in at most ``b`` bits share at least
``8 - b`` of them (6 for two bits). Postings of single bytes would pair a 256th of the table with itself, so a posting is
five positional bytes, one less than the least that a pair shares: a fingerprint stands in C(8, 5) = 56 postings, and a
pair that shares six bytes meets in C(6, 5) = 6 of them, the guaranteed minimum; one that shares seven or eight, in more.
Meetings are tallied over all postings by pair, pairs below the minimum go, and the rest is verified bit by bit.

Postings of one fingerprint go before any pair is made. In one of more than PAIRWISE (different) fingerprints pairs would
grow with the square: there each fingerprint looks up its neighbours within the bits that the posting leaves free, which
finds every link of that posting at once, and a spanning star of each linked group is handed on. A pair that meets in such
a posting needs no tally; all others meet in small ones only and are tallied whole. So nothing is dropped and no group is
quadratic.

Only distinct fingerprints enter the index (copies stand behind a representative), and components are found by
contracting edges round by round, never on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import documents, materialize, slices, utf8

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Postings up to this size hand on their pairs for the tally; larger ones look up neighbours.
PAIRWISE = 16


def fingerprint(text: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of ``words``-word shingles, repeats included: a bit is 1 if set in over half the hashes. No words: 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens) - words + 1
    if n <= 1:
        return _majority(np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    digest = xxhash.xxh64_digest
    starts = [0, *(ends[:-1] + 1).tolist()]
    return _majority(np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist(), strict=False)]), ">u8"))


def _majority(hashes: np.ndarray) -> int:
    by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    out, bits = 0, (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
    for p in range(8):
        ones = np.bincount(by_byte[:, p], minlength=256) @ bits
        for one in ones:
            out = out << 1 | int(2 * one > len(hashes))
    return out


def with_fingerprints(df: DataFrame, words: int = SHINGLE_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) for every row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fps = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.record_batch([part.column(key), pa.array(fps, pa.int64())], [key, "fp"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key), utf8(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, fp long")


def meetings(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of each posting of 2 to PAIRWISE rows, smaller fingerprint first. Rows are ordered by posting (``keys``), then fingerprint."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    run_len = np.repeat(lengths, lengths)
    small = np.flatnonzero((run_len > 1) & (run_len <= PAIRWISE))
    low, high = [fps[:0]], [fps[:0]]
    if small.size:
        f, k = fps[small], keys[small]
        for shift in range(1, int(run_len[small].max())):
            same = np.flatnonzero(k[shift:] == k[:-shift])
            low.append(f[same])
            high.append(f[same + shift])
    return np.concatenate(low), np.concatenate(high)


def neighbours(fps: np.ndarray, keys: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within ``max_bits`` bits of each posting of more than PAIRWISE rows, found by flipping the bits that vary in it."""
    low, high = [fps[:0]], [fps[:0]]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    lengths = np.diff(np.r_[starts, len(keys)])
    for s, n in zip(starts[lengths > PAIRWISE], lengths[lengths > PAIRWISE], strict=True):
        f = np.sort(fps[s : s + n])
        varying = [b for b in range(64) if int(np.bitwise_or.reduce(f ^ f[0])) >> b & 1]
        for flip in (sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in combinations(varying, k)):
            other = f ^ np.uint64(flip)
            at = np.searchsorted(f, other)
            hit = np.flatnonzero((at < n) & (f[np.minimum(at, n - 1)] == other) & (other > f))
            low.append(f[hit])
            high.append(other[hit])
    return np.concatenate(low), np.concatenate(high)


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups that the links (a, b) join, as (member, smallest member); as many rows as members that aren't smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            break
        label = new
    out = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[out], nodes[label[out]]


def tally(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v, met, joined): how often each pair of fingerprints meets in small postings, and whether a large one has joined it.

    ``fps`` has one row (fp) for each distinct fingerprint. A joined pair belongs to one group; it need not be a link itself.
    """
    need = 8 - max_bits  # positional bytes that a pair shares at least
    if need < 2:
        raise ValueError("the byte-position index needs max_bits below 7")
    masks = [sum(0xFF << (8 * p) for p in kept) for kept in combinations(range(8), need - 1)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("pos", "bytes"))
    # The bytes that a mask clears are free: the posting's number is kept apart so that equal bytes at other positions stay apart.
    postings = postings.withColumn("pos", F.col("pos").cast("tinyint")).repartition("pos", "bytes").sortWithinPartitions("pos", "bytes", "fp")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            pos, key, fp = cols
            number = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])])
            met = meetings(fp, number)
            near = neighbours(fp.view(np.uint64), number, max_bits)
            u, v = star(near[0].view(np.int64), near[1].view(np.int64)) if len(near[0]) else near
            low, high = np.r_[met[0], np.minimum(u, v).view(np.int64)], np.r_[met[1], np.maximum(u, v).view(np.int64)]
            if len(low):
                yield pa.record_batch([pa.array(low), pa.array(high), pa.array(np.arange(len(low)) >= len(met[0]))], ["u", "v", "joined"])

        carry: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("pos", "bytes", "fp")]
            if carry is not None:
                cols = [np.concatenate(x) for x in zip(carry, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = int(last[-1]) + 1 if last.size else 0
            if cut:
                yield from flush([c[:cut] for c in cols])
            carry = [c[cut:] for c in cols]
        if carry is not None and len(carry[0]):
            yield from flush(carry)

    found = postings.select("pos", "bytes", "fp").mapInArrow(meet, "u long, v long, joined boolean")
    return found.groupBy("u", "v").agg(F.count_if(~F.col("joined")).alias("met"), F.bool_or("joined").alias("joined"))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) between fingerprints that span every group joined by ``max_bits`` or fewer differing bits.

    The count filter keeps pairs that met as often as the guaranteed minimum; what it keeps is verified.
    """
    least = comb(8 - max_bits, 7 - max_bits)
    near = (F.col("met") >= least) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)
    return tally(fps, max_bits).where(F.col("joined") | near).select("u", "v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v), for every node that has an edge.

    Each round hooks every node to its smallest neighbour, follows the pointers until they rest, and contracts the edges;
    two rounds leave at most half the nodes, so rounds grow with the logarithm of the table, and they go on until no edge is
    left. Every round is written to the shared folder. Hubs are no problem: the minimum is combined before the shuffle and
    joins may be split.
    """
    spark = edges.sparkSession
    live = materialize(edges.where("u <> v").select("u", "v"), "edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.select(F.col("u").alias("node"), F.col("v").alias("other")).unionAll(live.select(F.col("v").alias("node"), F.col("u").alias("other")))
        parents = materialize(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent")), "hooks")
        # A parent is smaller than its child, so the pointers form trees; a jump halves their depth.
        resting = False
        while not resting:
            for _ in range(2):
                up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
                parents = parents.select("node", "parent").join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.coalesce(F.col("grand") != F.col("parent"), F.lit(False)).alias("moved"))
            parents = materialize(parents, "parents")
            resting = parents.where("moved").isEmpty()
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("node").alias("component"), "parent")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = materialize(labels, "labels")
        pu, pv = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu")), parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = live.join(pu, "u").join(pv, "v").where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        live = materialize(moved, "edges")
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")


def near_duplicates(df: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``df`` (doc_id, text and any others).

    component_id is the smallest doc_id reachable over links of ``max_bits`` or fewer differing bits, the row's own
    included. Null and empty texts have fingerprint 0 and link like any other. Rows whose ids are equal share nothing but
    the id. A null id never is a component_id; a component of null ids only has a null one. An empty table gives none.
    """
    docs = materialize(with_fingerprints(df, words), "fingerprints")
    reps = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "representatives")
    found = components(near_links(reps.select("fp"), max_bits))
    group = reps.join(found, reps.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("g"))
    low = group.groupBy("g").agg(F.min("least").alias("component_id"))
    return docs.join(group.join(low, "g").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` less all rows of a near-duplicate group but one, that of the smallest doc_id.

    Rows that share an id and a text are one document, of which one row stays (by a hash of their other columns); different
    texts under one id stay or go together, and stay if one of them is kept. A row without an id goes by a hash of its
    text (a number beyond common ids), so that different texts stay apart.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62)))
    keyed = docs.withColumn("__key", key)
    found = near_duplicates(keyed.select(F.col("__key").alias("doc_id"), "text"), words, max_bits)
    keepers = found.where("doc_id = component_id").select(F.col("doc_id").alias("__key")).distinct()
    kept = keyed.join(keepers, "__key", "left_semi")
    others = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("__0"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "doc_id")])))
    # A minimum combines before rows move, so that many repeats of one document are no task of their own.
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.col("__others")).alias("row")
    same = ["__key", F.xxhash64("text").alias("__h"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("__c")]
    return kept.withColumn("__others", others).groupBy(*same).agg(row).select("row.*")
