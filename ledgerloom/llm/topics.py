"""Topics of documents: clusters of their term vectors, for corpora that carry no topic labels.

Longer words are hashed to TERMS terms; document frequencies are counted over all documents. Centroids are fitted by
spherical k-means on the TF-IDF vectors of all documents, which are worked out and written once: each seed and each round is
a pass over them, from which only a document or the clusters' sums (topics by terms) come back. Sums are integers, so the fit doesn't depend on how
rows are partitioned.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import codes, materialize, slices, words_of

TOPICS, TERMS = 8, 4096
#: Words from so many bytes on are terms.
TERM_BYTES = 5
ROUNDS = 20
#: Parts of a unit vector's entry that are added up; a billion documents' sums fit a long.
GRAIN = 1 << 30
#: Texts counted at once: 64 MB of counts.
ROWS = 2_000
#: Entries that a row of packed vectors holds (with its last text's, 120 KB at most), and rows that a pass reads at once.
ENTRIES, GATHERED = 1 << 14, 16
#: Parquet row groups of packed vectors. Spark's reader holds up to 4,096 rows of a group at once, here all of it; Parquet looks at sizes every 100 rows only.
GROUP_BYTES = 16 << 20


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each text's distinct terms, ordered, and each text's number of words. A-Z count as small letters."""
    words, coded = words_of(texts, lower=True)
    term = np.array([zlib.crc32(w) % TERMS if len(w) >= TERM_BYTES else -1 for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)
    token = term[codes(coded)] if len(coded) else np.empty(0, np.int64)
    key = (np.repeat(np.arange(len(words)), words) * TERMS + token)[token >= 0]
    # Few rows a batch: counting by place is cheaper than sorting tokens.
    count = np.bincount(key, minlength=len(words) * TERMS)
    key = np.flatnonzero(count)
    return key // TERMS, key % TERMS, count[key], words


@dataclass
class Topics:
    """Weight of a term by topic: centroid times inverse document frequency."""

    idf: np.ndarray
    centroids: np.ndarray  # (topic, term)

    def of(self, row: np.ndarray, term: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
        """The nearest centroid of each text; 0 for texts without terms and where no term tells topics apart."""
        near = np.zeros((rows, len(self.centroids)))
        if len(row):
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            weight = (1 + np.log(count)) * self.idf[term]
            near[row[first]] = likeness(first, term, weight, self.centroids)
        return near.argmax(1)


def with_terms(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``df``, tokens (long: the text's words) and terms (binary: term and count pairs, uint32) of every row."""
    own = df.select(F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes=4 << 20, max_rows=ROWS):
                row, term, count, words = terms_of(part.column("text"))
                pairs = np.c_[term, count].astype("<u4").tobytes()
                at = 8 * np.searchsorted(row, np.arange(len(words) + 1))
                yield pa.record_batch([part.column("row"), pa.array(words, pa.int64()), pa.array([pairs[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["row", "tokens", "terms"])

    return own.mapInArrow(run, f"row {own.schema['row'].dataType.simpleString()}, tokens long, terms binary").select("row.*", "tokens", "terms")


def _unpacked(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blobs = terms.to_pylist()
    pairs = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs]), pairs[:, 0], pairs[:, 1]


def unit_vectors(terms: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, weight) of the texts' TF-IDF vectors of length 1, and whether a text has one: some have no term that counts."""
    row, term, count = _unpacked(terms)
    weight = (1 + np.log(count)) * idf[term]
    size = np.sqrt(np.bincount(row, weight * weight, len(terms)))
    return row, term, np.divide(weight, size[row], out=np.zeros_like(weight), where=size[row] > 0), size > 0


def likeness(first: np.ndarray, term: np.ndarray, weight: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cosines (text, centroid), rounded so that sums in any order compare alike. ``first``: where each text's terms begin; none is without."""
    return np.round(np.stack([np.add.reduceat(c.take(term) * weight, first) for c in centroids], axis=1), 9)


def _packs(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """(texts, h, sizes, terms, weights): unit vectors of ``rows`` (h, terms), ENTRIES or a little more a row, so that a pass reads arrays and works nothing out again.

    Texts whose terms all weigh nothing are left out. Weights are kept as float32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, term, weight, there = unit_vectors(part.column("terms"), idf)
                if there.any():
                    own, size = there[row], np.bincount(row, minlength=len(there))[there]
                    end = np.cumsum(size)
                    cut = np.flatnonzero(np.diff((end - size) // ENTRIES)) + 1
                    texts = (part.column("h").to_numpy()[there], size.astype("<u2"))
                    arrays = [np.split(a, cut) for a in texts] + [np.split(a, end[cut - 1]) for a in (term[own].astype("<u2"), weight[own].astype("<f4"))]
                    yield pa.record_batch([pa.array([len(h) for h in arrays[0]]), *[pa.array([a.tobytes() for a in each], pa.binary()) for each in arrays]], ["texts", "h", "sizes", "terms", "weights"])

    return rows.mapInArrow(run, "texts long, h binary, sizes binary, terms binary, weights binary")


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(h, size, first, term, weight) of the rows of ``_packs``, GATHERED of them at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, GATHERED):
            part = batch.slice(at, GATHERED)
            h, sizes, terms, weights = [np.frombuffer(b"".join(v.as_buffer() for v in part.column(c)), kind) for c, kind in (("h", "<i8"), ("sizes", "<u2"), ("terms", "<u2"), ("weights", "<f4"))]
            size = sizes.astype(np.int64)
            yield h, size, np.cumsum(size) - size, terms.astype(np.int64), weights.astype(float)


def fit(termed: DataFrame, key: str = "doc_id", topics: int = TOPICS, rounds: int = ROUNDS) -> Topics:
    """Topics of a written table of ``with_terms``, from all its rows; without terms there is one weightless topic."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(TERMS, np.int64)
        for batch in batches:
            n += batch.num_rows
            for at in range(0, batch.num_rows, ROWS):
                total += np.bincount(_unpacked(batch.column("terms").slice(at, ROWS))[1], minlength=TERMS)
        if n:
            yield pa.record_batch([pa.array(np.r_[np.arange(TERMS), -1]), pa.array(np.r_[total, n])], ["term", "n"])

    counted = {r.term: r.n for r in termed.select("terms").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents = counted.get(-1, 0)
    idf = np.log((documents + 1) / (np.array([counted.get(t, 0) for t in range(TERMS)]) + 1.0))
    rows = termed.where(F.length("terms") > 0).select(F.xxhash64(F.col(key).cast("string"), "terms").alias("h"), "terms")
    packs = materialize(_packs(rows, idf), "vectors", group_bytes=GROUP_BYTES)

    def farthest(seeds: np.ndarray):
        """Of the texts read at once, the one least like any seed."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, size, first, term, weight in _vectors(batches):
                near = likeness(first, term, weight, seeds).max(1) if len(seeds) else np.zeros(len(h))
                i = np.lexsort((h, near))[0]
                of = slice(first[i], first[i] + size[i])
                yield pa.record_batch([pa.array([near[i]]), pa.array([h[i]]), pa.array([term[of].tolist()], pa.list_(pa.int64())), pa.array([weight[of].tolist()], pa.list_(pa.float64()))], ["near", "h", "term", "weight"])

        return run

    def added(centroids: np.ndarray):
        """The sums of the texts nearest to each centroid, by topic and term."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(centroids) * TERMS, np.int64)
            for _, size, first, term, weight in _vectors(batches):
                nearest = likeness(first, term, weight, centroids).argmax(1)
                # Whole numbers below 2**53 add up exactly.
                total += np.bincount(np.repeat(nearest * TERMS, size) + term, np.rint(weight * GRAIN), len(total)).astype(np.int64)
            # A task's sums are one row a topic, not one an entry.
            yield pa.record_batch([pa.array(np.arange(len(centroids))), pa.array([t.tobytes() for t in total.reshape(-1, TERMS)], pa.binary())], ["topic", "total"])

        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topic, total = None, np.zeros(TERMS, np.int64)
        for batch in batches:
            topic = batch.column("topic")[0] if batch.num_rows else topic
            for each in batch.column("total"):
                total += np.frombuffer(each.as_buffer(), np.int64)
        yield pa.record_batch([pa.array([topic.as_py()]), pa.array([total.tobytes()], pa.binary())], ["topic", "total"])

    seeds = np.zeros((0, TERMS))
    while len(seeds) < topics:
        found = packs.mapInArrow(farthest(seeds), "near double, h long, term array<long>, weight array<double>").orderBy("near", "h", "term", "weight").limit(1).collect()
        if not found or found[0].near >= 1 - 1e-6:
            break
        seed = np.zeros(TERMS)
        seed[found[0].term] = found[0].weight
        seeds = np.vstack([seeds, seed])
    if not len(seeds):
        return Topics(idf, np.zeros((1, TERMS)))
    centroids, before = seeds, None
    for _ in range(rounds):
        total = np.zeros(len(centroids) * TERMS, np.int64)
        for r in packs.mapInArrow(added(centroids), "topic long, total binary").groupBy("topic").applyInArrow(summed, "topic long, total binary").collect():
            total[r.topic * TERMS : (r.topic + 1) * TERMS] = np.frombuffer(r.total, np.int64)
        if before is not None and np.array_equal(total, before):
            break
        before, total = total, total.reshape(-1, TERMS).astype(float)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centroids = np.where(size > 0, total / np.maximum(size, 1.0), centroids)
    return Topics(idf, centroids)


def spherical_kmeans(x: np.ndarray, topics: int, rounds: int = ROUNDS) -> np.ndarray:
    """``fit``'s clusters for vectors in memory: unit centroids of the unit rows of ``x``, from seeds that lie far from each other; fewer where rows are fewer or alike."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    seeds, near = [0], x @ x[0]
    while len(seeds) < topics and near.min() < 1 - 1e-6:
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    centroids, before = x[seeds], None
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(1)
        if before is not None and np.array_equal(nearest, before):
            break
        before = nearest
        for k in range(len(centroids)):
            total = x[nearest == k].sum(0)
            if (length := np.linalg.norm(total)) > 0:
                centroids[k] = total / length
    return centroids.astype(float)


def with_topics(termed: DataFrame, topics: Topics) -> DataFrame:
    """A table of ``with_terms`` with topic (int) in place of terms."""
    own = [c for c in termed.columns if c != "terms"]
    rows = termed.select(F.struct(*own).alias("row"), "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                topic = topics.of(*_unpacked(part.column("terms")), part.num_rows)
                yield pa.record_batch([part.column("row"), pa.array(topic, pa.int32())], ["row", "topic"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, topic int").select("row.*", "topic")
