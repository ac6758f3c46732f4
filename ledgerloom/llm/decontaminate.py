"""Benchmark decontamination: one Aho-Corasick automaton over the test items' windows, texts scanned once.

Texts are normalised byte for byte (A-Z lower-cased, whatever parts words becomes a space), so every word keeps its place
in the original. A window is ``WINDOW`` consecutive words of an item; an item of fewer words is one window. Each distinct
word of the items is one character for the automaton, all other words of a text are one more, so that a batch of texts is
scanned as one string of words.

The automaton holds ``PART_WORDS`` item words at most, counted before anything is sent to executors. Larger benchmarks are
cut into parts, long items into chunks that overlap by a window less a word, and texts pass each part's automaton in turn.

Null and empty texts have no words and no hits. Items without words are never found; repeated items count once; a null
item_id is an item named by the empty string. Every row is judged on its own, whatever ids and texts repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.shared import codes, documents, materialize, parts_for, slices, words_of

WINDOW = 10
#: Item words in one automaton, of some ten nodes each: about 100 MB a Python worker.
PART_WORDS = 200_000
#: Windows that begin in one chunk of an item.
CHUNK = 5_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: The character of all words that no item holds; it also stands between texts.
_OTHER = 1
#: Characters of item words: after _OTHER, without the surrogates.
_FIRST, _SURROGATES, _SKIP = 2, 0xD800, 0x800

FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def normalised(texts: pa.Array) -> pa.Array:
    """The texts' bytes with A-Z in lower case and a space for each byte that parts words; places stay."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = bytes(memoryview(texts.buffers()[2])[ends[0] : ends[-1]]) if len(texts) and ends[-1] > ends[0] else b""
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(data.translate(_PLAIN))])


def _characters(codes: np.ndarray) -> str:
    shifted = codes + np.where(codes >= _SURROGATES, _SKIP, 0)
    return shifted.astype("<u4").tobytes().decode("utf-32-le")


class Automaton:
    """The windows of some items: ``find`` tells which windows end where."""

    def __init__(self, names: list[str], items: list[list[str]], window: int = WINDOW) -> None:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for words in items for w in words))}
        self.vocabulary = pa.array(list(vocabulary), pa.large_string())
        self.names = np.array(sorted(set(names)), object)
        rank = {n: i for i, n in enumerate(self.names)}
        windows: dict[str, set[int]] = {}
        for name, words in zip(names, items, strict=True):
            line = _characters(np.array([vocabulary[w] for w in words], np.int64) + _FIRST)
            for at in range(max(1, len(line) - window + 1) if line else 0):
                windows.setdefault(line[at : at + window], set()).add(rank[name])
        self.length = np.array([len(w) for w in windows], np.int64)
        holders = [sorted(h) for h in windows.values()]
        self.first = np.cumsum([0, *map(len, holders)])
        self.holders = np.array([h for each in holders for h in each], np.int64)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, line in enumerate(windows):
            self.machine.add_word(line, number)
        if windows:
            self.machine.make_automaton()

    def find(self, counts: np.ndarray, words: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit: whether each word lies in a window, row and item: the pairs of a text and an item with a window in it)."""
        total, rows = int(counts.sum()), len(counts)
        none = np.empty(0, np.int64)
        if not len(self.length) or not total:
            return np.zeros(total, bool), none, none
        known = pc.fill_null(pc.index_in(words.dictionary.cast(pa.large_string()), value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        code = np.where(known < 0, _OTHER, known + _FIRST)
        # A text's words, then one character that ends it.
        row = np.repeat(np.arange(rows), counts)
        line = np.full(total + rows, _OTHER, np.int64)
        line[np.arange(total) + row] = code[codes(words)]
        met = np.array(list(self.machine.iter(_characters(line))), np.int64).reshape(-1, 2)
        last, number = met[:, 0], met[:, 1]
        edge = np.zeros(total + rows + 1, np.int64)
        np.add.at(edge, last - self.length[number] + 1, 1)
        np.add.at(edge, last + 1, -1)
        hit = np.cumsum(edge)[np.arange(total) + row] > 0
        where = np.searchsorted(np.cumsum(counts + 1), last, side="right")
        pairs = np.unique(where * len(self.length) + number)
        where, number = np.divmod(pairs, len(self.length))
        many = self.first[number + 1] - self.first[number]
        at = np.repeat(self.first[number] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        pairs = np.unique(np.repeat(where, many) * len(self.names) + self.holders[at])
        return hit, *np.divmod(pairs, len(self.names))


@lru_cache(maxsize=1)
def _built(key: tuple[int, int], shipped: Broadcast) -> Automaton:
    """A worker builds a part's automaton once; ``key`` is what tells parts and runs apart."""
    return Automaton(*shipped.value)


def _spans(text: bytes, plain: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as [start, end) in code points of ``text``."""
    solid = np.frombuffer(plain, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, solid, False]))
    starts, ends = edges[::2], edges[1::2]
    points = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    runs = np.flatnonzero(np.diff(np.r_[False, hit, False]))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in runs.reshape(-1, 2)]


def _pass(rows: DataFrame, shipped: Broadcast, part: int, last: bool) -> DataFrame:
    """``rows`` (row, found) with what one part's automaton finds added to ``found``; spans are told by the last part."""
    schema, key = T.StructType([rows.schema["row"], T.StructField("found", FOUND)]), (id(shipped), part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _built(key, shipped)
        for batch in batches:
            for piece in slices(batch, "row.text"):
                texts = pc.fill_null(piece.column("row").field("text").cast(pa.large_binary()), b"")
                plain = normalised(texts)
                counts, words = words_of(plain)
                hit, where, item = machine.find(counts, words)
                ends = np.cumsum(counts)
                cut = np.searchsorted(where, np.arange(piece.num_rows + 1))
                found = []
                for i, before in enumerate(piece.column("found").to_pylist()):
                    mine, names = hit[ends[i] - counts[i] : ends[i]], machine.names[item[cut[i] : cut[i + 1]]].tolist()
                    if before and before["hits"]:
                        mine = mine | np.unpackbits(np.frombuffer(before["hits"], np.uint8), count=len(mine)).astype(bool)
                        names = sorted({*names, *before["items"]})
                    some = bool(names)
                    spans = _spans(texts[i].as_py(), plain[i].as_buffer().to_pybytes(), mine) if some and last else []
                    found.append({"n_words": int(counts[i]), "n_hit": int(mine.sum()), "items": names, "hits": np.packbits(mine).tobytes() if some and not last else None, "spans": spans})
                yield pa.record_batch([piece.column("row"), pa.array(found, _ARROW)], ["row", "found"])

    return rows.mapInArrow(run, schema)


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hits", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def item_chunks(benchmark: DataFrame, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """(name, words): the items' words, long items in chunks that hold every window once; no items without words, no repeats."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(chunk))
    return items.select("name", "words", F.explode(starts).alias("at")).select("name", F.slice("words", F.col("at") + 1, F.lit(chunk + window - 1)).alias("words")).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """(row, found) of every row of ``docs`` (text, and any other columns, which ``row`` keeps whatever they are called).

    found: n_words, n_hit (words inside an occurrence of a window), items (their item_ids as sorted strings) and spans, the
    runs of hit words as [start, end) in code points of the original text.
    """
    chunks = item_chunks(benchmark, window, min(CHUNK, part_words))
    total = chunks.agg(F.sum(F.size("words"))).first()[0] or 0
    n = parts_for(total, part_words)
    if n > 1:
        chunks = materialize(chunks.withColumn("part", F.pmod(F.xxhash64("name", "words"), F.lit(n))), "items")
    rows = docs.select(F.struct("*").alias("row"), F.lit(None).cast(FOUND).alias("found"))
    for part in range(n):
        # Bounded: a part holds part_words words, give or take the hash's fluctuation.
        held = (chunks.where(F.col("part") == part) if n > 1 else chunks).select("name", "words").collect()
        held.sort()
        shipped = docs.sparkSession.sparkContext.broadcast(([r[0] for r in held], [r[1] for r in held], window))
        rows = _pass(rows, shipped, part, last=part == n - 1)
        if part < n - 1:
            rows = materialize(rows, "scanned")
    return rows


def keep_clean(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0) -> DataFrame:
    """The rows of ``docs`` of whose words at most ``max_share`` lie in benchmark windows, with their own columns."""
    return scan(docs, benchmark).where(F.col("found.n_hit") <= max_share * F.col("found.n_words")).select("row.*")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of ``benchmark``, and a digest of the items they come from; spans and names stay with ``scan``."""
    found = scan(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.sha2(F.array_join("found.items", ",").cast("binary"), 256)
    return found.select("row.doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))
