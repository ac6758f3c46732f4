"""The pipeline's stages against plain computations on a small corpus."""

from collections import Counter

import pyarrow.parquet as pq

import corpus_pipeline
from ledgerloom.llm import packing
from ledgerloom.llm.shared import materialize, tokenizer_path


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], small), name))
    for df in out[1:-1]:
        assert df.columns == list(corpus_pipeline.COLUMNS)
    raw, good, single, clean, mixed, packed = [df.collect() for df in out]
    assert Counter(good) <= Counter(raw) and len(good) < len(raw)
    quality = dict(zip(*[pq.read_table(f"{small}/labels.parquet")[c].to_pylist() for c in ("doc_id", "quality")], strict=True))
    known = [r for r in raw if r.doc_id in quality]
    kept = {r.doc_id for r in good}
    assert sum((r.doc_id in kept) == bool(quality[r.doc_id]) for r in known) >= 0.97 * len(known)
    # One document of each group at a Jaccard similarity of 0.8 stays: the smallest.
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets = {r.doc_id: shingles(r.text) for r in good}
    group = {i: i for i in sets}
    near = [(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    assert len(near) >= 20
    for _ in range(20):
        for i, j in near:
            group[i] = group[j] = min(group[i], group[j])
    assert sorted(r.doc_id for r in single) == sorted(set(group.values()))
    assert [r.doc_id for r in sorted(clean)] == [r.doc_id for r in sorted(single)]
    assert all(r.n_chars == len(r.text) for r in clean if r.text is not None)
    assert set(mixed) <= set(clean)
    # Packing loses nothing and overfills nothing.
    import pyarrow as pa

    ids, counts = packing.token_ids(pa.array([r.text or "" for r in mixed], pa.string()), tokenizer_path())
    want = {r.doc_id: int(n) for r, n in zip(mixed, counts, strict=True)}
    got = Counter()
    fill = {}
    for p in packed:
        got[p.doc_id] += p.length
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == Counter(want) and len(ids) == sum(want.values())
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
