"""Best-fit packing of tokenised documents into fixed-length sequences by hierarchical residual packing.

A document is its token ids and one end id; only documents longer than a sequence are cut, and their full pieces are
sequences at once. The rest are items for best-fit decreasing packing: every partition packs its own, emits the bins
that are nearly full, and hands the others on as items of the next round, in which fewer partitions pack them together
again; so items meet new partners level by level, as in a tree, while no task ever holds more than ``items_per_task``.
Rounds end when joining no longer closes bins. What a bin holds travels with it, so nothing is looked up afterwards.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.shared import codes, documents, materialize, parts_for, slices, tokenizer_path, words_of

CAPACITY = 2048
END = 0
#: A bin with at most so many free tokens leaves the tree.
NEARLY_FULL = 8
ITEMS_PER_TASK = 40_000
#: Pieces in the items of one task, as a mean.
MEMBERS_PER_TASK = 400_000
#: Words whose ids a Python worker remembers between batches.
REMEMBERED = 500_000
TRAILING = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_memory: dict[str, tuple[object, dict[bytes, bytes]]] = {}


def _tokenizer(path: str) -> tuple[object, dict[bytes, bytes]]:
    if path not in _memory:
        from tokenizers import Tokenizer

        _memory[path] = (Tokenizer.from_file(path), {})
    return _memory[path]


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level vocabularies write for each byte: itself where it is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


_BYTES = _byte_letters()


def _pieces_of(word: bytes) -> tuple[bytes, ...]:
    """``word`` or its body and trailing ASCII punctuation, which the pre-tokenizer separates anyhow."""
    body = word.rstrip(TRAILING)
    if body and len(body) < len(word) and b"<" not in word and body.decode()[-1].lower().isalpha():
        return body, word[len(body) :]
    return (word,)


def _letters(piece: bytes) -> str | None:
    """What the vocabulary's merges see of a piece that its normaliser and pre-tokenizer leave whole: letters only; null for other pieces."""
    s = piece.decode()
    if s.isascii():
        return s.lower() if s.isalpha() else None
    # Capital sigma has two small letters; beyond U+2000 letters may be newer than the vocabulary's tables.
    if "\u03a3" in s or max(s) >= "\u2000" or not unicodedata.is_normalized("NFC", s):
        return None
    s = s.lower()
    return s.encode().decode("latin-1").translate(_BYTES) if s.isalpha() else None


def _encoded(words: list[bytes], tokenizer: object, known: dict[bytes, bytes]) -> list[bytes]:
    """Each word's ids as uint32 bytes. What is new is encoded in pieces and remembered while there is room."""
    blobs = [known.get(w) for w in words]
    missing = [i for i, b in enumerate(blobs) if b is None]
    if missing:
        parts = [_pieces_of(words[i]) for i in missing]
        new = list({p for w in parts for p in w if p not in known})
        merges, fresh, rest = tokenizer.model, {}, []
        for p in new:
            letters = _letters(p)
            if letters is None:
                rest.append(p)
            else:
                fresh[p] = array("I", [t.id for t in merges.tokenize(letters)]).tobytes()
        for k in range(0, len(rest), 20_000):
            chunk = rest[k : k + 20_000]
            for p, e in zip(chunk, tokenizer.encode_batch([c.decode() for c in chunk], add_special_tokens=False), strict=True):
                fresh[p] = array("I", e.ids).tobytes()
        both = ChainMap(fresh, known) if len(known) + len(new) + len(missing) > REMEMBERED else known
        if both is known:
            known.update(fresh)
        for i, w in zip(missing, parts, strict=True):
            blobs[i] = both[w[0]] if len(w) == 1 else both[w[0]] + both[w[1]]
        if both is known:
            known.update((words[i], blobs[i]) for i in missing)
    return blobs


def token_ids(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids (uint32) of all texts' tokens, end id included, one after the other, and each text's count.

    This vocabulary's tokens never span white space, so each distinct word of the batch is encoded once and the ids are
    gathered from there.
    """
    tokenizer, known = _tokenizer(path)
    # The vocabulary lower-cases everything but special tokens, which it looks for first.
    count, coded = words_of(texts, lower=not pc.any(pc.match_substring(texts, "<|")).as_py())
    offsets = np.r_[0, np.cumsum(count)]
    blobs = _encoded(coded.dictionary.cast(pa.large_binary()).to_pylist(), tokenizer, known)
    ids = np.frombuffer(b"".join(blobs), np.uint32)
    sizes = np.fromiter((len(b) // 4 for b in blobs), np.int64, len(blobs))
    starts = np.cumsum(sizes) - sizes
    # One word more, holding the end id, goes after each text's words.
    at = np.insert(codes(coded), offsets[1:], len(blobs))
    ids, sizes, starts = np.append(ids, np.uint32(END)), np.append(sizes, 1), np.append(starts, len(ids))
    n = sizes[at]
    ends = np.cumsum(n)
    out = ids[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    total = np.r_[0, ends][offsets[1:] + np.arange(1, len(offsets))]
    return out, np.diff(np.r_[0, total])


def pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row a piece: key, piece (int), start, length, ids_crc32 (long) and, if asked for, ids (binary, uint32).

    A null or empty text is its end id alone. ``vocabulary`` is a path that every executor can open.
    """
    fields = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or tokenizer_path()
        for batch in batches:
            for part in slices(batch):
                ids, counts = token_ids(part.column("text"), path)
                number = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), number)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
                start = piece * capacity
                length = np.minimum(capacity, counts[row] - start)
                begin = (np.cumsum(counts) - counts)[row] + start
                data = memoryview(ids.astype("<u4").tobytes())
                blobs = [data[4 * b : 4 * (b + n)] for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                cols = [part.column(key).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(b) for b in blobs], pa.int64())]
                names = [key, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array([bytes(b) for b in blobs], pa.binary())], [*names, "ids"]
                yield pa.record_batch(cols, names)

    return df.select(F.col(key), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {fields}")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of indices into ``sizes``. Open bins are kept by free room, so each item costs a binary search."""
    bins: list[list[int]] = []
    rooms: list[int] = []  # the distinct free rooms that some open bin has, ascending
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda j: (-sizes[j], j)):
        at = bisect_left(rooms, sizes[i])
        if at == len(rooms):
            room, b = capacity, len(bins)
            bins.append([i])
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[b].append(i)
        if room := room - sizes[i]:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins


ITEM = "bin long, used int, full boolean, members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"


def _pack(rows: list[tuple[int, list[dict]]], capacity: int, slack: int) -> Iterator[tuple[int, bool, list[dict]]]:
    for group in best_fit([used for used, _ in rows], capacity):
        members, at = [], 0
        for i in group:
            members += [m | {"offset": m["offset"] + at} for m in rows[i][1]]
            at += rows[i][0]
        yield at, capacity - at <= slack, members


def _packer(capacity: int, slack: int, label: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        frames = list(frames)  # items_per_task rows and MEMBERS_PER_TASK members, as a mean
        rows = [(int(u), [dict(x) for x in m]) for f in frames for u, m in zip(f["used"], f["members"], strict=True)]
        base = (label << 56) + (TaskContext.get().partitionId() << 28)
        out = [(base + i, used, full, members) for i, (used, full, members) in enumerate(_pack(rows, capacity, slack))]
        for k in range(0, len(out), 5000):
            yield pd.DataFrame(out[k : k + 5000], columns=["bin", "used", "full", "members"])

    return run


def dealt(live: DataFrame, tasks: int, number: int) -> DataFrame:
    """The items of a written table over ``tasks`` partitions, by a hash of their places in it."""
    numbered = live.select("used", "members", F.xxhash64(F.monotonically_increasing_id(), F.lit(number)).alias("__deal"))
    return numbered.repartition(tasks, "__deal").select("used", "members")


def pack(found: DataFrame, capacity: int = CAPACITY, slack: int = NEARLY_FULL, items_per_task: int = ITEMS_PER_TASK, max_rounds: int = 12) -> DataFrame:
    """``found`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset, gapless from 0 in each sequence.

    Any piece fits (lengths are 1 to ``capacity``); repeated rows are packed as often as they come; no rows give none.
    ``found`` should be a written table: rows are dealt by their place in it, so that a task that is lost finds the same
    ones again, and equal rows spread like others.
    """
    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("bigint").alias("offset"))
    items = found.select(F.col("length").cast("int").alias("used"), (F.col("length") >= capacity - slack).alias("full"), F.array(member).alias("members"))
    ready = items.where("full").select(F.monotonically_increasing_id().alias("bin"), "used", "full", "members")
    # Numbers of their own in case no round runs.
    done, live = [ready], items.where("not full").select((F.monotonically_increasing_id() + F.lit(1 << 62)).alias("bin"), "used", "full", "members")
    waiting, members = live.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
    for number in range(1, max_rounds + 1):
        if not waiting:
            break
        tasks = max(parts_for(waiting, items_per_task), parts_for(members, MEMBERS_PER_TASK))
        packed = materialize(dealt(live, tasks, number).mapInPandas(_packer(capacity, slack, number), ITEM), f"round{number}")
        done.append(packed.where("full"))
        live = packed.where("not full")
        left, members = live.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("members")), F.lit(0))).first()
        # A single task has seen all that is left; elsewhere a round that closes or joins hardly any bins is the last.
        if tasks == 1 or left > 0.98 * waiting:
            done.append(live)
            break
        waiting = left
    else:
        done.append(live)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("bin").alias("sequence_id"), F.inline("members"))


def pack_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    found = materialize(pieces(df, capacity, vocabulary), "pieces")
    return pack(found, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"))
