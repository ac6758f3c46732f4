import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import packing as P
from ledgerloom.llm.shared import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", "   \n\t", "Hello, World! it's <|endoftext|> don't <|ENDOFTEXT|> x<|startoftext|>y", "Ünïcode café é ́x ​ zero  nbsp 😀😀 ΣΑΣ",
    "a1b2 3.14 !!! $$$ word&&& THE!! 'tis ''s 's'", "the of and " * 3000, "x" * 9000, "|" * 50, "naïve — “quoted” text… ½ ² ß ǅ İ",
]


def ids_of(text):
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_equal_the_tokenizer():
    texts = [t or "" for t in TEXTS]
    ids, counts = P.token_ids(pa.array(texts), tokenizer_path())
    at = np.r_[0, np.cumsum(counts)]
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(t), t


def verify(rows, texts, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for d, text in texts.items():
        ids, at = ids_of(text), 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            part = ids[at : at + r.length]
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert r.length == capacity or at + r.length == len(ids)
            at += r.length
        assert at == len(ids)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_seq)


def test_packing_is_whole_and_tight(spark):
    texts = dict(enumerate(TEXTS)) | {100 + i: "the " * (7 * i % 1900) for i in range(300)}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, piece string")
    rows = P.pack_documents(df).collect()
    bins = verify(rows, texts, P.CAPACITY)
    assert bins <= 1.03 * sum(r.length for r in rows) / P.CAPACITY + 1


def test_rounds_join_what_partitions_left(spark):
    texts = {i: "the " * (100 + 37 * i % 900) for i in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = P.pieces(df)
    rows = P.pack(found, items_per_task=40).collect()
    bins = verify(rows, texts, P.CAPACITY)
    assert bins <= 1.05 * sum(r.length for r in rows) / P.CAPACITY + 1


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert P.pack_documents(df).count() == 3
    assert P.pack_documents(df.limit(0)).collect() == []
