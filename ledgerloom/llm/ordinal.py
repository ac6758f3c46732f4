"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

``P(grade > k) = logistic(w.x - threshold_k)``: all thresholds share the weights, so grades stay ordered, and the
expected severity is the sum of these probabilities. Features are words and stems (lower case, bare of punctuation), with one
weight for presence and one for density each; they are chosen from a bounded labelled sample by how strongly they go with
the label. Where labels only say toxic or not, grades above 0 come from the sample: toxic documents whose share of marker
words lies above the toxic median are grade 2, the others grade 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import codes, documents, fold, materialize, slices, words_of
from ledgerloom.llm.textstats import labelled_sample

SAMPLE_ROWS = 15_000
FEATURES = 4_096
LEAST_DOCUMENTS = 5
#: Lengths in characters of the stems that are features beside whole words.
STEMS = (5, 7)
STEPS, RATE, RIDGE = 300, 0.1, 1e-4
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"


def features_of(word: str) -> list[str]:
    """A word's features: itself and its stems, so that invented compounds of a marker count with it."""
    bare = word.lower().strip(_EDGE)
    return [f"{n}:{bare[:n]}" for n in STEMS if len(bare) > n] + [f"w:{bare}"] if bare else []


def feature_counts(texts: pa.Array, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature hash, count) of the distinct features of each text, ordered by row, and each text's number of words.

    ``only``: ascending hashes of the features that count. Each distinct word of the batch is taken apart once.
    """
    words, coded = words_of(texts)
    known: dict[str, int] = {}
    parts = [[known.setdefault(f, len(known)) for f in features_of(w)] for w in coded.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh64_intdigest(f) for f in known], np.uint64)
    if only is not None:
        use = np.isin(hashes, only)
        parts = [[f for f in p if use[f]] for p in parts]
    size = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    flat = np.fromiter((f for p in parts for f in p), np.int64, int(size.sum()))
    first = np.cumsum(size) - size
    index = codes(coded)
    row = np.repeat(np.arange(len(words)), words)
    hit = np.flatnonzero(size[index] > 0) if len(index) else np.empty(0, np.int64)
    n = size[index[hit]]
    feature = flat[np.repeat(first[index[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    key, count = np.unique(np.repeat(row[hit], n) * max(len(known), 1) + feature, return_counts=True)
    return key // max(len(known), 1), hashes[key % max(len(known), 1)] if len(key) else np.empty(0, np.uint64), count, words


def _density(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.log1p(1000.0 * count / np.maximum(words, 1)) / 3.0


@dataclass
class Ordinal:
    """Features by hash (ascending), their weights for presence and for density, and the ordered thresholds."""

    features: np.ndarray
    presence: np.ndarray
    density: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """P(grade > k) as (text, k)."""
        row, feature, count, words = feature_counts(texts, self.features)
        at = np.searchsorted(self.features, feature)
        total = np.bincount(row, self.presence[at] + self.density[at] * _density(count, words[row]), len(words)) if len(row) else np.zeros(len(words))
        return 1 / (1 + np.exp(-np.clip(total[:, None] - self.thresholds[None, :], -30, 30)))


def _fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, features: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam over the whole sample."""
    n = len(grade)
    share = np.array([((grade > k).sum() + 0.5) / (n + 1) for k in range(grades - 1)])
    # Thresholds are a first one and positive gaps, so they can't cross.
    start = np.log((1 - share) / share)
    theta = np.r_[np.zeros(features), start[0], np.log(np.maximum(np.diff(start), 1e-2))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        w, cuts = theta[:features], np.cumsum(np.r_[theta[features], np.exp(theta[features + 1 :])])
        total = np.bincount(row, w[feature] * value, n)
        above = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(total[:, None] - cuts[None, :], -30, 30))), np.zeros(n)]
        p = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-9)
        slope = above * (1 - above)
        up, down = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
        d_total = (up - down) / p
        d_cut = np.array([((grade == k + 1) * -up / p + (grade == k) * down / p).sum() for k in range(grades - 1)])
        d_gap = np.cumsum(d_cut[::-1])[::-1]
        g = np.r_[np.bincount(feature, d_total[row] * value, features) / n - RIDGE * w, d_gap[0] / n, d_gap[1:] * np.exp(theta[features + 1 :]) / n]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return theta[:features], np.cumsum(np.r_[theta[features], np.exp(theta[features + 1 :])])


def fit(features: np.ndarray, marker: np.ndarray, row: np.ndarray, feature: np.ndarray, count: np.ndarray, words: np.ndarray, y: np.ndarray) -> Ordinal:
    """Learns from a sample's counts of the chosen ``features`` (``feature``: their hashes by entry).

    ``y`` may hold grades 0, 1, 2, ...; with 0 and 1 alone, grade 2 is worked out from the ``marker`` features. With one
    grade only the model is a constant.
    """
    y = y.astype(int)
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        none = np.empty(0)
        return Ordinal(none.astype(np.uint64), none, none, np.log((1 - share) / share) + np.array([0.0, 1.0]))
    f = np.searchsorted(features, feature)
    grade = y
    if y.max() == 1:
        share = np.bincount(row, marker[f] * count, len(y)) / np.maximum(words, 1)
        grade = y + ((y == 1) & (share > np.median(share[y == 1])))
    n = len(features)
    weights, cuts = _fit(np.r_[row, row], np.r_[f, f + n], np.r_[np.ones(len(f)), _density(count, words[row])], grade, 2 * n, int(grade.max()) + 1)
    return Ordinal(features, weights[:n], weights[n:], cuts)


def choose_features(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The at most FEATURES features that go most strongly with the label, and which of them mark toxic text.

    Document counts are added up per batch, then by Spark; only the chosen features come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, feature, _, _ = feature_counts(part.column("text"))
                known, at = np.unique(feature, return_inverse=True)
                toxic = part.column("y").to_numpy(zero_copy_only=False) > 0
                cols = [known.view(np.int64), np.bincount(at, minlength=len(known)), np.bincount(at, toxic[row].astype(float), len(known)).astype(np.int64)]
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["feature", "df", "hits"])

    n, toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0))).first()
    rate = toxic / max(n, 1)
    z = (F.col("hits") - rate * F.col("df")) / F.sqrt(F.col("df") * max(rate * (1 - rate), 1e-9))
    counted = sample.mapInArrow(run, "feature long, df long, hits long").groupBy("feature").agg(F.sum("df").alias("df"), F.sum("hits").alias("hits"))
    best = counted.where(F.col("df") >= LEAST_DOCUMENTS).withColumn("z", F.round(z, 6)).where("abs(z) > 2").orderBy(F.abs("z").desc(), "feature").limit(FEATURES).toPandas()
    hashes = best["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    strength = best["z"].to_numpy(float)[order]
    return hashes[order], strength > max(4.0, 0.25 * strength.max(initial=0.0))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Ordinal:
    """Fits on at most ``rows`` labelled training documents; what comes to the driver are their counts of the chosen features."""
    sample = labelled_sample(docs, labels, label, rows)
    sample = materialize(sample.select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text")), "toxic_sample")
    features, marker = choose_features(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, feature, count, words = feature_counts(part.column("text"), features)
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                blobs = [[a[s:e].tobytes() for s, e in zip(ends, ends[1:], strict=False)] for a in (feature.astype("<u8"), count.astype("<u4"))]
                yield pa.record_batch([part.column("doc_id"), part.column("y"), pa.array(words, pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]], ["doc_id", "y", "words", "feature", "count"])

    found = sample.mapInArrow(run, "doc_id long, y int, words long, feature binary, count binary").toPandas().sort_values("doc_id", kind="stable")
    feature = np.frombuffer(b"".join(found["feature"]), "<u8")
    count = np.frombuffer(b"".join(found["count"]), "<u4")
    row = np.repeat(np.arange(len(found)), [len(b) // 8 for b in found["feature"]])
    return fit(features, marker, row, feature, count, found["words"].to_numpy(), found["y"].to_numpy())


def grade_documents(df: DataFrame, model: Ordinal, key: str = "doc_id") -> DataFrame:
    """key, expected_severity (0 to the highest grade), p_toxic (some grade above 0) and grade (the likeliest) of every row.

    Null and empty texts hold no features, so the thresholds alone grade them; texts of any length are read whole; equal
    texts and repeated rows get equal numbers; of equally likely grades the lower one counts; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                above = model.probabilities(part.column("text"))
                each = -np.diff(np.c_[np.ones(len(above)), above, np.zeros(len(above))], axis=1)
                yield pa.record_batch([part.column(key), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(each.argmax(1).astype(np.int32))], [key, "expected_severity", "p_toxic", "grade"])

    text = F.coalesce("text", F.lit("")).alias("text")
    return df.select(F.col(key), text).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, expected_severity double, p_toxic double, grade int")


def op6_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = grade_documents(docs, model)
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "expected_severity", "p_toxic", "grade", (F.col("p_toxic") >= 0.5).cast("int").alias("predicted"))
