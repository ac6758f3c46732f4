import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

GOOD = "the river runs past old stone houses where people gather every evening to share bread and quiet stories about distant hills".split()
BAD = "BUY NOW!!! $$$ *** click|here <free> #deal #deal %%% && WIN".split()
RUDE = "grobulous snarkwit vexling".split()


def corpus():
    """Documents of two qualities and two tempers, with nulls, empty texts and repeated rows."""
    rng, rows, labels = random.Random(3), [], []
    for i in range(420):
        words = [rng.choice(GOOD if i % 3 else BAD) for _ in range(rng.randint(25, 90))]
        if i % 5 == 0:
            for _ in range(rng.choice((2, 12))):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        rows.append((i, " ".join(words), "en" if i % 4 else None, f"s{i % 3}"))
        if i % 10:
            labels.append((i, int(i % 3 > 0), int(i % 5 == 0)))
    # Near copies on both sides of a similarity of 0.8.
    for i in range(40):
        words = rows[3 * i + 1][1].split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        rows.append((500 + i, " ".join(words), "en", "s2"))
    rows += [(900, None, "en", "s0"), (901, "", "de", "s1"), (902, " \n ", None, None), (7, rows[7][1], "en", "s1")]
    return rows, labels


@pytest.fixture(scope="session")
def small(tmp_path_factory):
    """A folder with documents and labels."""
    where, (rows, labels) = tmp_path_factory.mktemp("small"), corpus()
    ids, texts, langs, sources = map(list, zip(*rows))
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": pa.array(sources, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(docs, where / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32())}), where / "labels.parquet")
    return str(where)


@pytest.fixture(scope="session")
def hollow(tmp_path_factory, small):
    """The same tables without rows."""
    where = tmp_path_factory.mktemp("hollow")
    for name in ("documents", "labels"):
        pq.write_table(pq.read_table(f"{small}/{name}.parquet").slice(0, 0), where / f"{name}.parquet")
    return str(where)
