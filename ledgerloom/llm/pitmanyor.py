"""Language-model scores from a hierarchical Pitman-Yor process, seated by Gibbs sampling.

Restaurants. Every token is a customer of the restaurant of its context, the word before it (a text's first word: the
start). All context restaurants share one parent, the unigram restaurant, whose own parent is uniform over the vocabulary
and one unseen word. Opening a table in a context sends one customer to the parent. With ``c`` customers of a word at ``t``
tables,

    P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) P(w)

and likewise for ``P(w)`` over the uniform base. What ties a cell's tables to other cells is made explicit by auxiliary
draws: a restaurant's pull, Gamma(theta / d + t_u), and the word's share in the unigram restaurant, a Beta draw from its
seating. Given both, the tables of ``c`` customers have probability in proportion to ``S_d(c, t) (d pull_u share_w)**t``
(``S_d``: the generalised Stirling number, which counts the seatings), whatever the other cells are, so a sweep draws all cells at once.
Table counts are averaged over samples after burn-in; the predictive probability is linear in them, so the averages give
the averaged prediction.

Spark. Texts are read once. A task turns its documents into blocks: word numbers, and the block's words by bucket (a hash
of the word). Buckets number their words and answer the blocks, which count their pairs of numbers and send each to the
bucket of its second word. A bucket seats its words; a context's tables lie in many buckets, so between passes buckets
send sums by context to the groups that own the contexts and get the pulls back, each only for the contexts it has. At the
end buckets answer each block with its pairs' own parts and its words' shares and tables, and blocks add up their documents.
A bucket with many tokens is gathered and answered by ranges of blocks; merged, it holds each different pair once, at most
as many a word as there are words. Words are numbered in order and random draws belong to buckets and groups, so scores
don't depend on how rows are partitioned. What lies between the passes is a table in the shared folder.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import codes, documents, fold, materialize, parts_for, slices, words_of

#: A word's id is its bucket shifted so far, plus its number there, plus 1; the start of a text, a context only, is 0.
SHIFT = 40
THETA = 1.0
#: Sweeps before and in which table counts are averaged, by pass. Powers of two make the averages' sums exact in any order.
BURN_IN, SAMPLES = (2, 2), (2, 4)
#: Dishes of so many customers are drawn from exact Stirling numbers; for larger ones the same law is taken at its saddle point.
EXACT = 256
BLOCK_BYTES = 16 << 20
#: Text bytes whose words make up about 200,000 entries: one bucket for so many.
BUCKET_BYTES = 12 << 20
#: A bucket whose tokens ask for more than this (PAIR_BYTES each at most) is split by ranges of blocks.
RANGE_BYTES = 16 << 20
PAIR_BYTES = 3
#: Buckets at least, so that small tables also use several cores.
MIN_BUCKETS = 32
#: Buckets that one task gathers, as a mean.
BUCKETS_PER_TASK = 8
#: Rows of two numbers that may be broadcast; beyond, Spark joins by shuffling.
BROADCAST_ROWS = 100_000
#: Cells that are drawn at once.
CELLS = 1 << 18
SEED = 7

NONE = np.empty(0, np.int64)


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, numbers' first bytes before their second; ``unpack_arrays`` gives them back."""
    head = b"".join(a.dtype.str.encode().ljust(4) + struct.pack("<q", len(a)) for a in arrays)
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    raw = struct.pack("<i", len(arrays)) + head + b"".join(planes)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_arrays(value: bytes) -> list[np.ndarray]:
    raw = pa.decompress(value[8:], struct.unpack("<q", value[:8])[0], codec="zstd", asbytes=True)
    n, out = struct.unpack_from("<i", raw)[0], []
    at = 4 + 12 * n
    for i in range(n):
        kind, size = np.dtype(raw[4 + 12 * i : 8 + 12 * i].decode().strip()), struct.unpack_from("<q", raw, 8 + 12 * i)[0]
        planes = np.frombuffer(raw, np.uint8, kind.itemsize * size, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += kind.itemsize * size
    return out


def steps(ids: np.ndarray) -> np.ndarray:
    """Rising ids as their differences, which pack well; ``np.cumsum`` gives them back."""
    return np.diff(ids, prepend=0)


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(lengths, dtype=np.int64)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encode_block(texts: pa.Array, doc_ids: pa.Array, held: np.ndarray, buckets: int) -> tuple[bytes, dict[int, bytes]]:
    """A block's documents as word numbers, and its dictionary's parts by bucket: words in byte order, their tokens, those of them in training.

    The end of a text is the word ``b""``. ``place`` says where among the parts' words, one part after the other, a word is.
    """
    n_words, coded = words_of(texts, lower=True)
    words = pa.concat_arrays([coded.dictionary.cast(pa.large_binary()), pa.array([b""], pa.large_binary())])
    listed = words.to_pylist()
    bucket = np.array([xxhash.xxh64_intdigest(w) % buckets for w in listed], np.int64)
    order = pc.sort_indices(words).to_numpy().astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    token = np.insert(codes(coded), np.cumsum(n_words), len(listed) - 1)
    counts = n_words + 1
    met = np.bincount(token, minlength=len(listed))
    trained = np.bincount(token[np.repeat(~held, counts)], minlength=len(listed)).astype(np.uint32)
    docs = pack_arrays(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), held.astype(np.uint8), counts.astype(np.uint32), token.astype(np.uint32), place.astype(np.uint32))
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    parts = {}
    for b in np.flatnonzero(np.diff(edge)).tolist():
        o = order[edge[b] : edge[b + 1]]
        ws = [listed[i] for i in o.tolist()]
        parts[b] = pack_arrays(np.array([len(w) for w in ws], np.uint32), np.frombuffer(b"".join(ws), np.uint8), met[o].astype(np.uint32), trained[o])
    return docs, parts


def encode(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(kind, block, bucket, payload): a row 'd' for each block's documents and rows 'w' for its dictionary. ``docs`` has doc_id, text, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, number, held_back, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held_back).combine_chunks()
            one = lambda c: t.column(c).chunk(0)
            block, parts = encode_block(one("text"), one("doc_id"), one("held").to_numpy(zero_copy_only=False), buckets)
            yield pa.record_batch([pa.array(["d"]), pa.array([first + number]), pa.array([-1], pa.int32()), pa.array([block], pa.binary())], ["kind", "block", "bucket", "payload"])
            n = len(parts)
            yield pa.record_batch([pa.array(["w"] * n), pa.array([first + number] * n), pa.array(list(parts), pa.int32()), pa.array(list(parts.values()), pa.binary())], ["kind", "block", "bucket", "payload"])

        for batch in batches:
            for part in slices(batch):
                more = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
                if held_back and size + more > block_bytes:
                    yield from flush()
                    number, held_back, size = number + 1, [], 0
                held_back.append(part)
                size += more
        if held_back:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), "held").mapInArrow(run, "kind string, block long, bucket int, payload binary")


def number_words(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A bucket's dictionary from the blocks' parts: each entry's word number (words in byte order), tokens by word, those in training, the parts' lengths."""
    parts = [unpack_arrays(p) for p in payloads]
    coded = pa.concat_arrays([_binary(p[1], p[0]) for p in parts]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number = rank[coded.indices.to_numpy(zero_copy_only=False)]
    added = lambda i: np.bincount(number, np.concatenate([p[i] for p in parts]).astype(float), len(order)).astype(np.int64)
    return number, added(2), added(3), [len(p[0]) for p in parts]


@dataclass
class Pairs:
    """A block's different pairs, in order of the second word's place, then the first's; a text's first word follows the start, place -1."""

    word: np.ndarray
    context: np.ndarray
    of_token: np.ndarray
    doc_ends: np.ndarray


def pairs_of(counts: np.ndarray, token: np.ndarray, place: np.ndarray) -> Pairs:
    at, n = place[token], len(place) + 1
    ends = np.cumsum(counts, dtype=np.int64)
    key = at.astype(np.int64)  # blocks have millions of tokens: in place
    key *= n
    key[1:] += at[:-1]
    key[1:] += 1
    starts = ends - counts
    key[starts] = at[starts].astype(np.int64) * n
    order = np.argsort(key)
    key = key[order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    of_token = np.empty(len(key), np.int32)
    of_token[order] = np.cumsum(fresh, dtype=np.int32) - 1
    del order
    key = key[fresh]
    return Pairs((key // n).astype(np.int32), (key % n - 1).astype(np.int32), of_token, ends)


def split_pairs(docs: bytes, buckets: list[int], replies: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, ranges, payload) of a block's pairs, from its documents and the numbers of its words, by bucket in order."""
    _, _, held, counts, token, place = unpack_arrays(docs)
    numbers = [unpack_arrays(r) for r in replies]
    number = np.concatenate([n[0] for n in numbers]).astype(np.int64)
    sizes = [len(n[0]) for n in numbers]
    ids = (np.repeat(np.array(buckets, np.int64), sizes) << SHIFT) + number + 1
    pairs = pairs_of(counts, token, place)
    trained = np.bincount(pairs.of_token[np.repeat(held == 0, counts)], minlength=len(pairs.word)).astype(np.uint32)
    edge = np.r_[0, np.cumsum(sizes)]
    pair_edge = np.searchsorted(pairs.word, edge)
    for i, b in enumerate(buckets):
        p = slice(pair_edge[i], pair_edge[i + 1])
        here, at = np.unique(pairs.context[p], return_inverse=True)
        contexts = np.where(here < 0, 0, ids[here])
        per_word = np.bincount(pairs.word[p] - edge[i], minlength=sizes[i])
        yield b, int(numbers[i][2][0]), pack_arrays(steps(number[edge[i] : edge[i + 1]]).astype(np.uint32), per_word.astype(np.uint32), steps(contexts), at.astype(np.uint32), trained[p])


@dataclass
class Sums:
    """Sums that seating a bucket needs. The numbers add up over buckets, the arrays are of a bucket's contexts."""

    words: float  # distinct training words
    tokens: float  # training tokens
    ones: float  # pairs seen once, twice; words in one context, two
    twos: float
    word_ones: float
    word_twos: float
    tables: float  # of the unigram restaurant
    guests: float  # its customers, the tables of all contexts
    customers: np.ndarray  # by context
    opened: np.ndarray  # tables by context

    def flat(self) -> list[float]:
        return [self.words, self.tokens, self.ones, self.twos, self.word_ones, self.word_twos, self.tables, self.guests]

    @property
    def discount(self) -> float:
        return float(np.clip(self.ones / max(self.ones + 2 * self.twos, 1), 0.05, 0.95))

    @property
    def word_discount(self) -> float:
        return float(np.clip(self.word_ones / max(self.word_ones + 2 * self.word_twos, 1), 0.05, 0.95))

    @property
    def uniform(self) -> float:
        return 1.0 / (self.words + 1)


@dataclass
class Bucket:
    """What a bucket (or a range of its blocks) knows: cells (word, context, customers) in order, its contexts' ids, and each block's words and pairs as numbers and cells (from 1; 0: not met in training).

    A core, which is what sampling moves about, has cells of several customers only; the others are counted by word and context.
    """

    words: pa.Array | range
    cell_word: np.ndarray
    cell_context: np.ndarray
    cell_count: np.ndarray
    contexts: np.ndarray
    blocks: np.ndarray
    block_words: np.ndarray
    entry_word: np.ndarray
    block_pairs: np.ndarray
    entry_cell: np.ndarray = field(default_factory=lambda: NONE)
    single_words: np.ndarray = field(default_factory=lambda: NONE)
    single_contexts: np.ndarray = field(default_factory=lambda: NONE)

    def pack(self) -> bytes:
        small = lambda a: a.astype(np.uint32 if a.max(initial=0) < 1 << 32 else np.int64)
        rest = (self.cell_word, self.cell_context, self.cell_count, steps(self.contexts), self.blocks, self.block_words, self.entry_word, self.block_pairs, self.entry_cell, self.single_words, self.single_contexts)
        return pack_arrays(np.array([len(self.words)]), *map(small, rest))

    @staticmethod
    def unpack(value: bytes) -> Bucket:
        size, *rest = (a.astype(np.int64) for a in unpack_arrays(value))
        rest[3] = np.cumsum(rest[3])
        return Bucket(range(int(size[0])), *rest)

    def core(self) -> Bucket:
        live = self.cell_count > 1
        width = self.width()
        alone = lambda a, n: np.bincount(a[~live], minlength=n)
        return Bucket(self.words, self.cell_word[live], self.cell_context[live], self.cell_count[live], self.contexts, NONE, NONE, NONE, NONE, NONE, alone(self.cell_word, len(self.words)), alone(self.cell_context, width))

    def width(self) -> int:
        return max(len(self.contexts), int(self.cell_context.max(initial=0)) + 1)

    def by_word(self, tables: np.ndarray) -> np.ndarray:
        """Tables added up by word, those of single customers with them."""
        return np.bincount(self.cell_word, tables, len(self.words)) + (self.single_words if len(self.single_words) else 0.0)

    def by_context(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell_context, tables, self.width()) + (self.single_contexts if len(self.single_contexts) else 0.0)

    def sums(self) -> Sums:
        """Of a bucket with all its cells, one table each."""
        contexts = np.bincount(self.cell_word, minlength=len(self.words))
        c, seen = self.cell_count, int((contexts > 0).sum())
        return Sums(seen, int(c.sum()), int((c == 1).sum()), int((c == 2).sum()), int((contexts == 1).sum()), int((contexts == 2).sum()), seen, len(c), self.by_context(c), self.by_context(np.ones(len(c))))


def _cells(word: np.ndarray, context: np.ndarray, count: np.ndarray, keep_empty: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of equal word and context id added up, in order, with the ids that remain; those without customers go unless ``keep_empty``. Last: each entry's cell from 1."""
    ids, at = np.unique(context, return_inverse=True)
    key, cell = np.unique(word * max(len(ids), 1) + at, return_inverse=True)
    total = np.bincount(cell, count.astype(float), len(key)).astype(np.int64)
    kept = (total > 0) | keep_empty
    word, at = np.divmod(key[kept], max(len(ids), 1))
    left, at = np.unique(at, return_inverse=True)
    return word, at, total[kept], ids[left], np.where(kept, np.cumsum(kept), 0)[cell]


def build_bucket(blocks: np.ndarray, payloads: list[bytes], some: bool = False) -> Bucket:
    """Joins the blocks' pairs of one bucket: counts of equal pairs add up. With ``some`` these are a range of its blocks, and pairs without training stay: others may have met them."""
    parts = [unpack_arrays(p) for p in payloads]
    numbers = [np.cumsum(p[0], dtype=np.int64) for p in parts]
    word = np.concatenate([np.repeat(n, p[1]) for n, p in zip(numbers, parts, strict=True)])
    context = np.concatenate([np.cumsum(p[2])[p[3]] for p in parts])
    *cells, entry = _cells(word, context, np.concatenate([p[4] for p in parts]), some)
    return Bucket(range(int(word.max()) + 1), *cells, blocks, np.array([len(n) for n in numbers]), np.concatenate(numbers), np.array([len(p[3]) for p in parts]), entry)


def merge_buckets(ranges: list[Bucket]) -> Bucket:
    """The cells of one bucket from those of its ranges; without the blocks' entries, which stay with the ranges."""
    *cells, _ = _cells(np.concatenate([r.cell_word for r in ranges]), np.concatenate([r.contexts[r.cell_context] for r in ranges]), np.concatenate([r.cell_count for r in ranges]))
    return Bucket(range(max(len(r.words) for r in ranges)), *cells, NONE, NONE, NONE, NONE)


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S_d(c, t) for t <= c <= most at c (c - 1) / 2 + t - 1: in how many ways, weighted by the discount, c customers sit at t tables."""
    out = np.full(most * (most + 1) // 2, -np.inf)
    row = np.zeros(1)
    out[0] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        stay = np.r_[row + np.log(c - discount * t), -np.inf]
        row = np.logaddexp(stay, np.r_[-np.inf, row])
        out[c * (c + 1) // 2 : c * (c + 1) // 2 + c + 1] = row
    return out


def _rising(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """log of x (x + 1) ... (x + t - 1), by a series around the middle factor."""
    m = x + (t - 1) / 2
    v = 1 / (m * m)
    return t * np.log(m) - t * (t * t - 1) * v * (1 / 24 + (3 * t * t - 7) * v / 960)


def _choose(log_weight: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For runs of ``size`` weights one place each (from 0), drawn in proportion to the weights."""
    first = np.cumsum(size) - size
    weight = np.exp(log_weight - np.repeat(np.maximum.reduceat(log_weight, first), size))
    ends = np.cumsum(weight)
    before = ends[first] - weight[first]
    at = np.searchsorted(ends, before + rng.random(len(size)) * (ends[first + size - 1] - before), side="right")
    return np.clip(at - first, 0, size - 1)


def saddle(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean (less 1) and variance of a dish's tables under weights S_d(c, t) a**t, for many customers ``c``.

    S_d has the generating function exp(a / d (1 - (1 - x)**d)): Poisson many tables of independent sizes, given their
    sum. x is taken where the expected sum is ``c``; as it nears 1 the law tends to 1 + Poisson(a / d).
    """
    low, high = np.full(len(c), -700.0), np.zeros(len(c))  # of log y, y = 1 - x
    for _ in range(60):
        mid = (low + high) / 2
        more = np.log(a) + np.log1p(-np.exp(np.minimum(mid, -1e-12))) + (d - 1) * mid > np.log(c)
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    y = np.exp(low)
    mean = a / d * (1 - y**d)
    return mean, np.maximum(mean - c / (1 + (1 - y) * (1 - d) / y), 0.0)


def _many(c: np.ndarray, a: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    mean, var = saddle(c, a, d)
    t = np.where(mean < 50, rng.poisson(np.minimum(mean, 50)), np.rint(mean + np.sqrt(var) * rng.standard_normal(len(c))))
    return np.clip(1 + t.astype(np.int64), 1, c)


@dataclass
class Seated:
    """Averages over samples: tables by cell, customers and tables of each word in the unigram restaurant."""

    tables: np.ndarray
    customers: np.ndarray
    parents: np.ndarray


def _draw_tables(c: np.ndarray, a: np.ndarray, d: float, few: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of ``c`` > 1 customers, each cell by weights S_d(c, t) a**t."""
    out = np.empty(len(c), np.int64)
    for first in range(0, len(c), CELLS):
        part = slice(first, first + CELLS)
        many = c[part] > EXACT
        new = np.empty(len(many), np.int64)
        if many.any():
            new[many] = _many(c[part][many].astype(float), np.maximum(a[part][many], 1e-12), d, rng)
        if not many.all():
            n, log_a, top = c[part][~many], np.log(a[part][~many]), a[part][~many] / d
            # More tables than this have no weight that counts: the law lies below 1 + Poisson(a / d).
            size = np.minimum(n, np.ceil(top + 8 * np.sqrt(top) + 10).astype(np.int64))
            t = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
            new[~many] = 1 + _choose(few[np.repeat(n * (n - 1) // 2, size) + t - 1] + t * np.repeat(log_a, size), size, rng)
        out[part] = new
    return out


def _draw_parents(customers: np.ndarray, now: np.ndarray, tables: float, s: Sums, few: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws all words' tables in the unigram restaurant, which has ``tables`` of them."""
    c, d = customers, s.word_discount
    others = np.maximum(tables - now, 0.0)
    new = np.minimum(c, 1)
    many = c > EXACT
    if many.any():
        new[many] = _many(c[many].astype(float), (THETA + d * others[many]) * s.uniform, d, rng)
    g = np.flatnonzero((c > 1) & ~many)
    if len(g):
        top = (THETA / d + others[g] + c[g]) * s.uniform
        size = np.minimum(c[g], np.ceil(top + 8 * np.sqrt(top) + 10).astype(np.int64))
        t = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + 1
        log_weight = few[np.repeat(c[g] * (c[g] - 1) // 2, size) + t - 1] + t * math.log(d * s.uniform) + _rising(np.repeat(THETA / d + others[g], size), t)
        new[g] = 1 + _choose(log_weight, size, rng)
    return new


def sample_bucket(b: Bucket, s: Sums, seed: tuple[int, ...], burn_in: int, samples: int, pull: np.ndarray | None = None) -> Seated:
    """Gibbs sweeps over the bucket's words.

    ``pull`` holds the contexts' draws, which come from all buckets' tables; the unigram restaurant's totals are those of
    ``s``. Without it the bucket is the whole model: pulls and totals follow its own seating in every sweep.
    """
    rng = np.random.default_rng(seed)
    d, d0 = s.discount, s.word_discount
    few, few0 = log_stirling(d), log_stirling(d0)
    live = np.flatnonzero(b.cell_count > 1)  # a single customer sits at one table
    count, word, context = b.cell_count[live], b.cell_word[live], b.cell_context[live]
    shared, at = np.unique(word, return_inverse=True)
    t = np.ones(len(b.cell_count), np.int64)
    customers = b.by_word(t).astype(np.int64)
    parents = np.minimum(customers, 1)
    tables, guests, whole = s.tables, s.guests, pull is None
    sums = Seated(np.zeros(len(t)), np.zeros(len(b.words)), np.zeros(len(b.words)))
    for sweep in range(burn_in + samples):
        if whole:
            pull, tables, guests = rng.gamma(THETA / d + b.by_context(t)), float(parents.sum()), float(customers.sum())
        if len(live):
            mine = customers[shared] - d0 * parents[shared]
            share = rng.beta(mine, np.maximum(THETA + guests - mine, THETA)) + (THETA + d0 * tables) / (THETA + guests) * s.uniform
            t[live] = _draw_tables(count, d * pull[context] * share[at], d, few, rng)
            customers = b.by_word(t).astype(np.int64)
        parents = _draw_parents(customers, np.minimum(parents, customers), tables, s, few0, rng)
        if sweep >= burn_in:
            sums.tables += t
            sums.customers += customers
            sums.parents += parents
    return Seated(sums.tables / samples, sums.customers / samples, sums.parents / samples)


def seated_sums(b: Bucket, s: Seated) -> Sums:
    """Sums of a bucket that is the whole model."""
    out = b.sums()
    out.tables, out.guests, out.opened = float(s.parents.sum()), float(s.customers.sum()), b.by_context(s.tables)
    return out


def word_probabilities(s: Seated, g: Sums) -> np.ndarray:
    """P(w) of the bucket's words under the global sums ``g`` of the averages."""
    return (s.customers - g.word_discount * s.parents + (THETA + g.word_discount * g.tables) * g.uniform) / (THETA + g.guests)


def predicted(own: np.ndarray, opened: np.ndarray, customers: np.ndarray, parent: np.ndarray, discount: float) -> np.ndarray:
    """P(w | u) from the pair's own part c_uw - d t_uw, the context's tables and customers, and P(w)."""
    return (own + (THETA + discount * opened) * parent) / (THETA + customers)


def pair_probabilities(b: Bucket, s: Seated, g: Sums, word: np.ndarray, context: np.ndarray) -> np.ndarray:
    """P(word | context) for pairs of a bucket that is the whole model, seen in training or not."""
    key = b.cell_word * b.width() + b.cell_context
    order, own = np.argsort(key), np.zeros(len(word))
    if len(key):
        at = order[np.minimum(np.searchsorted(key[order], word * b.width() + context), len(key) - 1)]
        own = np.where(key[at] == word * b.width() + context, b.cell_count[at] - g.discount * s.tables[at], 0.0)
    return predicted(own, g.opened[context], g.customers[context], word_probabilities(s, g)[word], g.discount)


def answers(e: Bucket, s: Seated, g: Sums, opened: np.ndarray, whole: Bucket | None = None) -> Iterator[tuple[int, bytes]]:
    """For each block its words' probabilities and tables as contexts, and its pairs' own parts, in the block's order.

    ``s`` has the tables of cells of several customers. ``whole``: the bucket with all cells, if ``e`` is a range of it.
    """
    b = whole or e
    own, live = np.full(len(b.cell_count), 1 - g.discount), b.cell_count > 1
    own[live] = b.cell_count[live] - g.discount * s.tables
    if whole is not None:
        shared, at = np.intersect1d(b.contexts, e.contexts, return_indices=True)[::2]
        known = np.full(len(e.contexts), -1)
        known[at] = np.searchsorted(b.contexts, shared)
        width = max(len(b.contexts), 1)
        key, mine = b.cell_word * width + b.cell_context, e.cell_word * width + known[e.cell_context]
        at = np.searchsorted(key, mine).clip(max=len(key) - 1) if len(key) else NONE
        own = np.where((key[at] == mine) & (known[e.cell_context] >= 0), own[at], 0.0) if len(key) else np.zeros(len(mine))
    own = np.r_[0.0, own].astype(np.float32)
    parent = word_probabilities(s, g).astype(np.float32)
    edge, pair_edge = np.r_[0, np.cumsum(e.block_words)], np.r_[0, np.cumsum(e.block_pairs)]
    for i, block in enumerate(e.blocks.tolist()):
        w = e.entry_word[edge[i] : edge[i + 1]]
        yield block, pack_arrays(parent[w], opened[w], own[e.entry_cell[pair_edge[i] : pair_edge[i + 1]]])


def _added(df: DataFrame) -> Sums:
    """The sums of all buckets; a few numbers."""
    rows = df.where("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").collect()
    return Sums(*([r.v for r in rows] or [0.0] * 8), NONE, NONE)


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


BY_BLOCK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("payload", pa.binary())])
NUMBERED = pa.schema([*BY_BLOCK, ("tokens", pa.int64()), ("trained", pa.int64()), ("words", pa.int64()), ("ranges", pa.int32())])
SPLIT = pa.schema([*BY_BLOCK, ("range", pa.int32()), ("ranges", pa.int32())])
BUILT = pa.schema([("bucket", pa.int32()), ("range", pa.int32()), ("ranges", pa.int32()), ("payload", pa.binary()), ("core", pa.binary()), ("sums", pa.list_(pa.float64()))])
#: Between buckets and the groups that own contexts; a bucket's own row is of group -1, a seated one's too.
SENT = pa.schema([("bucket", pa.int32()), ("group", pa.int32()), ("payload", pa.binary()), ("sums", pa.list_(pa.float64()))])


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.list_(pa.float64()): "array<double>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def context_groups(contexts: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The groups that own rising context ids, and where theirs are. Groups are runs of buckets and grow as their root, so messages stay few and groups small."""
    groups = min(buckets, 16 * math.isqrt(buckets))
    group = (contexts >> SHIFT) * groups // buckets
    edge = np.searchsorted(group, np.arange(groups + 1))
    for k in np.flatnonzero(np.diff(edge)).tolist():
        yield k, slice(edge[k], edge[k + 1])


def score_documents(docs: DataFrame, seed: int = SEED, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text, held; other columns are ignored).

    The model learns from rows whose ``held`` is false. A null or empty text is its end alone; repeated rows are scored
    (and learnt) as often as they come, each alike; a null id is a row like any other; without training rows every word
    has the probability of an unseen one; an empty table gives none.
    """
    whole = docs.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 8).alias("size"), F.count_if(~F.col("held")).alias("texts")).first()
    size, texts = whole["size"] or 0, whole["texts"]
    buckets = max(MIN_BUCKETS, parts_for(size, bucket_bytes))
    bucket_tasks, block_tasks = parts_for(buckets, BUCKETS_PER_TASK), parts_for(size, 2 * block_bytes)
    encoded = materialize(encode(docs, buckets, block_bytes), "encoded", partition_by="kind")
    blocks = encoded.where("kind = 'd'").select("block", "bucket", "payload")

    def number(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("block").combine_chunks()
        numbers, tokens, trained, lengths = number_words(t.column("payload").to_pylist())
        ranges, edge = parts_for(PAIR_BYTES * int(tokens.sum()), range_bytes), np.r_[0, np.cumsum(lengths)]
        out = []
        for i, block in enumerate(t.column("block").to_pylist()):
            n = numbers[edge[i] : edge[i + 1]]
            out.append((block, key[0].as_py(), pack_arrays(n.astype(np.uint32), trained[n], np.array([ranges])), *((int(tokens.sum()), int(trained.sum()), int((trained > 0).sum())) if i == 0 else (0, 0, 0)), ranges))
        return _rows(NUMBERED, out)

    dictionary = encoded.where("kind = 'w'").select("block", "bucket", "payload").repartition(bucket_tasks, "bucket")
    numbered = materialize(dictionary.groupBy("bucket").applyInArrow(number, _ddl(NUMBERED)), "numbered")
    numbers = numbered.select("block", "bucket", "payload")
    about = numbered.agg(F.sum("trained").alias("tokens"), F.sum("words").alias("words")).first()
    tokens, vocabulary = about["tokens"] or 0, about["words"] or 0
    large = numbered.where("ranges > 1").groupBy("bucket").agg(F.max("ranges").alias("ranges"))
    split = large.count()

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        t, block = table.sort_by("bucket").combine_chunks(), key[0].as_py()
        docs, *replies = t.column("payload").to_pylist()
        found = split_pairs(docs, t.column("bucket").to_pylist()[1:], replies)
        return _rows(SPLIT, [(block, b, v, xxhash.xxh64_intdigest(struct.pack("<q", block)) % ranges, ranges) for b, ranges, v in found])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by("block").combine_chunks()
        bucket, at, ranges = (k.as_py() for k in key)
        b = build_bucket(t.column("block").to_numpy(), t.column("payload").to_pylist(), ranges > 1)
        last = (b.core().pack(), b.sums().flat()) if ranges == 1 else (None, None)
        return _rows(BUILT, [(bucket, at, ranges, b.pack(), *last)])

    met = blocks.unionByName(numbers).repartition(block_tasks, "block").groupBy("block").applyInArrow(pairs, _ddl(SPLIT))
    dealt = met.repartition(bucket_tasks, "bucket", "range", "ranges").groupBy("bucket", "range", "ranges")
    parts = materialize(dealt.applyInArrow(build, _ddl(BUILT)), "buckets")
    nothing = F.lit(None).cast("array<double>").alias("sums")
    state = parts.where("ranges = 1").select("bucket", F.lit(-1).alias("group"), F.col("core").alias("payload"), "sums")
    if split:

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            b = merge_buckets([Bucket.unpack(v) for v in table.sort_by("range").column("payload").to_pylist()])
            return _rows(SENT, [(key[0].as_py(), -1, b.core().pack(), b.sums().flat()), (key[0].as_py(), 3, b.pack(), None)])

        merged = materialize(parts.where("ranges > 1").select("bucket", "range", "payload").groupBy("bucket").applyInArrow(merge, _ddl(SENT)), "merged_buckets")
        state = state.unionByName(merged.where("group = -1"))
    start = _added(state)
    discount = start.discount

    def sent(bucket: int, b: Bucket, tables: np.ndarray) -> list[tuple]:
        opened = b.by_context(tables)
        return [(bucket, k, pack_arrays(steps(b.contexts[at]), opened[at]), None) for k, at in context_groups(b.contexts, buckets)]

    def open_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, value in zip(batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                b = Bucket.unpack(value.as_py())
                yield from _rows(SENT, sent(bucket, b, np.ones(len(b.cell_count)))).to_batches()

    def gathered(table: pa.Table) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        t = table.sort_by("bucket").combine_chunks()
        parts = [unpack_arrays(v) for v in t.column("payload").to_pylist()]
        ids, at = np.unique(np.concatenate([np.cumsum(p[0]) for p in parts]), return_inverse=True)
        return t.column("bucket").to_pylist(), [len(p[0]) for p in parts], ids, at, np.bincount(at, np.concatenate([p[1] for p in parts]), len(ids))

    def pulls(step: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            group = key[0].as_py()
            to, sizes, ids, at, opened = gathered(table)
            pull = np.random.default_rng((seed, 2, step, group)).gamma(THETA / discount + opened).astype(np.float32)
            edge = np.r_[0, np.cumsum(sizes)]
            return _rows(SENT, [(b, group, pack_arrays(pull[at[edge[i] : edge[i + 1]]]), None) for i, b in enumerate(to)])

        return run

    def sample(s: Sums, step: int):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            bucket = key[0].as_py()
            own, *replies = table.sort_by("group").column("payload").to_pylist()
            b = Bucket.unpack(own)
            pull = np.concatenate([unpack_arrays(r)[0] for r in replies] or [NONE]).astype(float)
            seats = sample_bucket(b, s, (seed, step, bucket), BURN_IN[step], SAMPLES[step], pull)
            sums = [0.0] * 6 + [float(seats.parents.sum()), float(seats.customers.sum())]
            return _rows(SENT, [(bucket, -1, pack_arrays(seats.tables, seats.customers, seats.parents), sums), *sent(bucket, b, seats.tables)])

        return run

    def passed(messages: DataFrame, s: Sums, step: int) -> tuple[DataFrame, Sums]:
        """Pulls from the tables that buckets sent, then a pass; its rows, and the sums that it leaves."""
        pulled = messages.groupBy("group").applyInArrow(pulls(step), _ddl(SENT))
        both = state.select("bucket", "group", "payload").unionByName(pulled.select("bucket", "group", "payload"))
        done = materialize(both.repartition(bucket_tasks, "bucket").groupBy("bucket").applyInArrow(sample(s, step), _ddl(SENT)), f"pass_{step}")
        after = _added(done)
        return done, Sums(*start.flat()[:6], after.tables, after.guests, NONE, NONE)

    opening = state.select("bucket", "payload").mapInArrow(open_one, _ddl(SENT)).where("group >= 0").repartition(bucket_tasks, "group")
    first, middle = passed(opening, start, 0)
    second, last = passed(first.where("group >= 0").repartition(bucket_tasks, "group"), middle, 1)

    def totals(key: tuple, table: pa.Table) -> pa.Table:
        """Tables by context for the buckets that the contexts' words belong to; the start's for the driver."""
        _, _, ids, _, opened = gathered(table)
        owner, out = ids >> SHIFT, []
        for b in np.unique(owner).tolist():
            at = (owner == b) & (ids > 0)
            out.append((b, 1, pack_arrays((ids[at] & ((1 << SHIFT) - 1)) - 1, opened[at]), opened[ids == 0].tolist() if b == 0 and ids[0] == 0 else None))
        return _rows(SENT, out)

    owned = materialize(second.where("group >= 0").repartition(bucket_tasks, "group").groupBy("group").applyInArrow(totals, _ddl(SENT)), "totals")
    begun = owned.where("sums IS NOT NULL").select(F.col("sums")[0]).first()
    start_opened = begun[0] if begun else 0.0

    def spread(df: DataFrame) -> DataFrame:
        """Each row once for every range of its bucket."""
        if not split:
            return df.withColumn("range", F.lit(0))
        ranges = F.broadcast(large) if split <= BROADCAST_ROWS else large
        return df.join(ranges, "bucket", "left").withColumn("range", F.explode(F.sequence(F.lit(0), F.coalesce("ranges", F.lit(1)) - 1))).drop("ranges")

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        rows = {r["group"]: r["payload"] for r in table.select(["group", "payload"]).to_pylist()}
        if 2 not in rows:  # a range without blocks
            return _rows(BY_BLOCK, [])
        seats = Seated(*unpack_arrays(rows[-1]))
        opened = np.zeros(len(seats.customers), np.float32)
        if 1 in rows:
            at, tables = unpack_arrays(rows[1])
            opened[at] = tables
        whole = Bucket.unpack(rows[3]) if 3 in rows else None
        return _rows(BY_BLOCK, [(block, key[0].as_py(), v) for block, v in answers(Bucket.unpack(rows[2]), seats, last, opened, whole)])

    part = lambda df, group: df.select("bucket", F.lit(group).alias("group"), "payload", "range")
    asked = part(parts, 2).unionByName(part(spread(second.where("group = -1")), -1)).unionByName(part(spread(owned), 1))
    if split:
        asked = asked.unionByName(part(spread(merged.where("group = 3")), 3))
    replies = asked.repartition(bucket_tasks, "bucket", "range").groupBy("bucket", "range").applyInArrow(answer, _ddl(BY_BLOCK))

    def score(key: tuple, table: pa.Table) -> pa.Table:
        t = table.sort_by([("bucket", "ascending"), ("answer", "ascending")]).combine_chunks()
        payloads, kinds = t.column("payload").to_pylist(), t.column("answer").to_pylist()
        ids, missing, held, counts, token, place = unpack_arrays(payloads[0])
        pairs = pairs_of(counts, token, place)
        told = [[unpack_arrays(v) for v, k in zip(payloads[1:], kinds[1:], strict=True) if k == kind] for kind in (0, 1)]
        count = np.concatenate([p[1] for p in told[0]])
        parent, opened, own = (np.concatenate([p[i] for p in told[1]]).astype(float) for i in range(3))
        # The start is the context before all words: the last place, which -1 means.
        p = predicted(own, np.r_[opened, start_opened][pairs.context], np.r_[count, texts][pairs.context], parent[pairs.word], discount)
        base = np.log10((count + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        at, word, log_p = pairs.doc_ends - counts, place[token], np.log10(p)
        added = lambda v: np.add.reduceat(v, at)
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=missing.astype(bool)), "held_out": pa.array(held.astype(bool)), "n_tokens": pa.array(counts, pa.int64()), "n_known": pa.array(added((count > 0).astype(np.int64)[word])), "base_score": pa.array(added(base[word])), "score": pa.array(added(log_p[pairs.of_token]))})

    told = lambda df, kind: df.select("block", "bucket", "payload", F.lit(kind).alias("answer"))
    both = told(blocks, 0).unionByName(told(numbers, 0)).unionByName(told(replies, 1))
    # As many partitions as the text's size asks for: a task gathers a few blocks, whatever their number.
    found = both.repartition(block_tasks, "block").groupBy("block").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity a token of training and of held-out documents, under the base and under the model."""
    each = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scored.groupBy("held_out").agg(each("base_score").alias("base_perplexity"), each("score").alias("perplexity"), F.sum("n_tokens").alias("n_tokens"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir).select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held")))
