"""Learned operators: exact statistics by brute force, and accuracy on rows that training never saw."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import gam, mixing, ordinal, pitmanyor, rules, textstats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def texts_of(folder):
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


def labels_of(folder, name):
    t = pq.read_table(f"{folder}/labels.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t[name].to_pylist(), strict=True))


def plain_stats(text):
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            hit.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.mark.parametrize("text", ["", " \n", "a b c d e f", "a b c d e a b c d e", "a a a a a a a", "x y # é|<\nx\nx\n x\n\n", "ü b c d e q ü b c d e q ü b c d e\n" * 3])
def test_base_statistics(text):
    assert textstats.base_stats(text.encode()) == plain_stats(text)


def test_quality_query(spark, small):
    rows, known = gam.op5_quality_gam(spark, small).collect(), labels_of(small, "quality")
    assert len(rows) == len(texts_of(small))
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def test_toxicity_query(spark, small):
    rows, known = ordinal.op6_toxicity_ordinal(spark, small).collect(), labels_of(small, "toxic")
    assert len(rows) == len(texts_of(small))
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    assert all(0 <= r.expected_severity <= 2 and r.p_toxic <= r.expected_severity + 1e-12 for r in rows)


def test_rules_query(spark, small):
    rows, known = rules.op9_quality_rules(spark, small).collect(), labels_of(small, "quality")
    want = Counter((i, *plain_stats(t or "")) for i, t in texts_of(small))
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    judged = [r for r in rows if not r.base_failed and fold(r.doc_id, 3) == 1 and r.doc_id in known]
    assert sum(r.kept == known[r.doc_id] for r in judged) >= 0.95 * len(judged) > 0


def test_rules_agree_with_their_sql(spark):
    rng = np.random.default_rng(5)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] < 0.5) | (x[:, 2] > 0.9)
    learnt = rules.learn(x, bad, ["a", "b", "c"])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    both = df.select(rules.verdict(learnt).alias("v"), F.expr(rules.as_sql(learnt)).alias("w"), "a", "b", "c").collect()
    assert all(r.v == r.w for r in both)
    assert sum((r.v is not None) == ((r.a > 0.7 and r.b < 0.5) or r.c > 0.9) for r in both) > 0.95 * len(both)
    assert rules.learn(x, np.zeros(600, bool), ["a", "b", "c"]) == [] and rules.as_sql([]) == "CAST(NULL AS INT)"


@pytest.mark.parametrize("query", [gam.op5_quality_gam, ordinal.op6_toxicity_ordinal, rules.op9_quality_rules, pitmanyor.op4_pitman_yor, mixing.op10_mix_sources])
def test_empty_tables(spark, hollow, query):
    assert query(spark, hollow).collect() == []


def test_language_model_query(spark, small):
    rows, docs = pitmanyor.op4_pitman_yor(spark, small).collect(), texts_of(small)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*WORD.findall((t or "").translate(lower)), ""]) for i, t in docs]
    count = Counter(w for i, ws in tokens if fold(i, 5) != 1 for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((i, fold(i, 5) == 1, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    twice = [r.score for r in rows if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_context_helps(spark):
    """Where words follow each other, the model beats the base on held-out texts."""
    text = " ".join(["alpha bravo charlie delta"] * 12)
    other = " ".join(["delta echo foxtrot golf"] * 12)
    df = spark.createDataFrame([(i, text if i % 2 else other, i % 5 == 1) for i in range(60)], "doc_id long, text string, held boolean")
    p = {r.held_out: r for r in pitmanyor.perplexity(pitmanyor.score_documents(df)).collect()}
    assert p[True].perplexity < 0.6 * p[True].base_perplexity


def test_raking_meets_its_targets():
    import pandas as pd

    rng = np.random.default_rng(2)
    cells = pd.DataFrame([(a, b, c, float(rng.integers(1, 100))) for a in "xyz" for b in "pq" for c in range(4)], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"x": 0.5, "y": 0.3, "z": 0.2}, "lang": {"p": 0.9, "q": 0.1}, "topic": {k: 0.25 for k in range(4)}}
    w, off = mixing.rake(cells, targets)
    assert off < 1e-9
    for d, t in targets.items():
        for value, share in t.items():
            assert abs(w[(cells[d] == value).to_numpy()].sum() - share) < 1e-6
    p = mixing.probabilities(w, cells["tokens"].to_numpy(), 0.6)
    assert (p <= 1).all() and abs((p * cells["tokens"]).sum() - 0.6 * cells["tokens"].sum()) < 1e-6


def test_mixing_query(spark, small):
    rows = mixing.op10_mix_sources(spark, small).collect()
    assert len(rows) == len(texts_of(small)) and all(0 <= r.probability <= 1 for r in rows)
    cells = {}
    for r in rows:
        cells.setdefault((r.source, r.lang, r.topic), set()).add((r.weight, r.probability))
    assert all(len(v) == 1 for v in cells.values())
    assert len({r.selected for r in rows if r.doc_id == 7 and r.source == "s1"}) == 1
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens * r.probability for r in rows) - mixing.BUDGET * total) < 0.01 * total
