"""Statistics of whole texts for the classifier and the rules, computed per Arrow batch inside tasks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import slices, utf8

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _DIGIT = bytes(range(65, 91)), b"0123456789"
_LETTERS = _UPPER + bytes(range(97, 123))
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_URLISH = re.compile(rb"https?:|www\.|@")


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(tokens: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in some ``window``-word passage occurring twice or more in the text, the first occurrence included."""
    n = len(tokens) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(t, len(number)) for t in tokens), np.int64, len(tokens))
    # Passages are numbered exactly, a word at a time: equal numbers are equal passages.
    code = ids[:n]
    for k in range(1, window):
        code = np.unique(code * len(number) + ids[k : k + n], return_inverse=True)[1]
    hit = np.bincount(code)[code] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(tokens) + 1, np.int64)
    edge[:n] += hit
    edge[window : window + n] -= hit
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_stats(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    tokens = text.split()
    bare = text.translate(None, _SPACE)
    lines = Counter(x for x in text.split(b"\n") if x.strip())
    return len(tokens), len(bare.translate(None, _CONTINUATION)), _count(text, SYMBOLS), sum(lines.values()) - len(lines), repeated_words(tokens)


#: What the classifier sees beside the base statistics; shares are of words or of characters in words.
SHAPE = ("mean_word", "symbol_share", "upper_share", "digit_share", "punct_share", "exclaim_share", "pipe_share", "long_word_share", "distinct_share", "same_next_share", "dup_line_share", "repeat_share", "words_per_line", "url_share", "log_words", "word_with_symbol_share")


def shape_stats(text: bytes, base: tuple[int, int, int, int, int] | None = None) -> list[float]:
    """The SHAPE features of one text; zeros for a text without words."""
    n, chars, symbols, dup, repeat = base or base_stats(text)
    if not n:
        return [0.0] * len(SHAPE)
    tokens = text.split()
    lines = text.count(b"\n") + 1
    return [
        chars / n,
        symbols / chars,
        _count(text, _UPPER) / chars,
        _count(text, _DIGIT) / chars,
        _count(text, _PUNCT) / chars,
        text.count(b"!") / n,
        text.count(b"|") / n,
        sum(len(t) > 14 for t in tokens) / n,
        len(set(tokens)) / n,
        sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
        dup / lines,
        repeat / n,
        n / lines,
        len(_URLISH.findall(text)) / n,
        float(np.log1p(n)),
        sum(t[-1:] in b"#*$%&|<>!" for t in tokens) / n,
    ]


def with_stats(df: DataFrame, key: str = "doc_id", shape: bool = False) -> DataFrame:
    """key, the BASE statistics (long) and, with ``shape``, features (array<double>, in SHAPE's order), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").to_pylist()
                base = [base_stats(t) for t in texts]
                cols = [part.column(key), *[pa.array([b[i] for b in base], pa.int64()) for i in range(len(BASE))]]
                names = [key, *BASE]
                if shape:
                    cols, names = [*cols, pa.array([shape_stats(t, b) for t, b in zip(texts, base, strict=True)], pa.list_(pa.float64()))], [*names, "features"]
                yield pa.record_batch(cols, names)

    fields = ", ".join(f"{n} long" for n in BASE) + (", features array<double>" if shape else "")
    return df.select(F.col(key), utf8().alias("text")).mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, {fields}")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, folds: int = 3, held: int = 1) -> DataFrame:
    """At most ``rows`` labelled training documents (doc_id, text, y): those of smallest id hash, so equal inputs give equal samples.

    Only rows whose fold is not ``held`` are seen; documents whose labels are null or contradict each other are left out.
    Rows that share an id are one document, with the smallest of their texts, so ``rows`` bounds what comes back.
    """
    from ledgerloom.llm.shared import fold

    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(fold("doc_id", folds) != held)
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("__y")).where("y = __y")
    chosen = known.select("doc_id", F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The limit is the bound: as many pairs of two numbers are broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
