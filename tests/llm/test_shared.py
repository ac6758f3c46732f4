import pyarrow as pa
import pytest

from ledgerloom.llm import shared as S


@pytest.mark.parametrize("lower", [True, False])
def test_words_of_slices(lower):
    texts = ["É One\ttwo", "", " Three\x0bfour\x0c", "ÀB\x1cC x\x85y", "zz " * 500, "LAST word"] * 50
    batch = pa.record_batch([pa.array(texts)], ["text"]).slice(7)
    at = 7
    for part in S.slices(batch, max_bytes=2000):
        count, coded = S.words_of(part.column("text"), lower)
        mine = [(t.encode().lower() if lower else t.encode()).split() for t in texts[at : at + part.num_rows]]
        assert count.tolist() == [len(m) for m in mine]
        assert [w.encode() for w in coded.cast(pa.large_string()).to_pylist()] == [w for m in mine for w in m]
        at += part.num_rows
    assert at == len(texts)
    assert list(S.slices(batch.slice(0, 0))) == []
