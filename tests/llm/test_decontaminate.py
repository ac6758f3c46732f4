"""Benchmark decontamination against a plain search word by word."""

import hashlib
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import decontaminate as D

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")
WORDS = "alpha Beta gamma délta 7 Ωmega x9 straße 日本 z".split()


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text, items):
    """(words, hit places, item names) by comparing every place with every window."""
    w, hit, names = words(text), set(), set()
    for name, item in items:
        cut = words(item)
        for at in range(max(1, len(cut) - 9) if cut else 0):
            gram = cut[at : at + 10]
            for i in range(len(w) - len(gram) + 1):
                if w[i : i + len(gram)] == gram:
                    hit.update(range(i, i + len(gram)))
                    names.add("" if name is None else str(name))
    return w, hit, sorted(names)


def tables():
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", ",", "!?", "\n"]) for _ in range(n))
    items = [(i, line(rng.choice((3, 9, 10, 11, 40)))) for i in range(40)]
    items += [(40, ""), (41, None), (42, " ,; "), (None, line(12)), (3, items[3][1]), (43, items[7][1]), (3, line(15)), (100, "ZULU"), (9, "q-r s")]
    docs = []
    for i in range(150):
        parts = [line(rng.randint(0, 30)) for _ in range(3)]
        if i % 3 == 0:
            parts.insert(rng.randrange(4), rng.choice(items)[1] or "")
        if i % 4 == 0:
            parts.insert(rng.randrange(4), " ".join(words(rng.choice(items)[1])[2:14]).upper())
        docs.append((i, "\t".join(parts)))
    docs += [(150, None), (151, ""), (152, " .,"), (3, docs[3][1]), (3, docs[3][1]), (None, items[0][1]), (153, "Q R S"), (154, "Zulu zulus ZULU"), (155, items[5][1] + " " + "q r " * 3000 + items[6][1])]
    return docs, items


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where, (docs, items) = tmp_path_factory.mktemp("bench"), tables()
    pq.write_table(pa.table({"doc_id": pa.array([d[0] for d in docs], pa.int64()), "text": [d[1] for d in docs], "row": ["x"] * len(docs), "found": [1] * len(docs)}), where / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i[0] for i in items], pa.int64()), "text": [i[1] for i in items]}), where / "benchmark.parquet")
    return str(where)


def test_query_is_the_plain_search(spark, folder):
    docs, items = tables()
    got = sorted(D.op11_decontaminate(spark, folder).collect(), key=str)
    want = []
    for doc_id, text in docs:
        w, hit, names = plain(text, items)
        want.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[-1] for w in want) > 50


def test_spans_lie_in_the_original_and_parts_agree(spark, folder):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    one = D.scan(docs, items).collect()
    many = D.scan(docs, items, part_words=60).collect()
    key = lambda r: str((r.row.doc_id, r.row.text, r.found.n_hit, r.found["items"], r.found.spans))
    assert sorted(map(key, one)) == sorted(map(key, many))
    for r in one:
        w, hit, names = plain(r.row.text, tables()[1])
        assert r.found["items"] == names
        inside = [words(r.row.text[s.start : s.end]) for s in r.found.spans]
        runs = [i for i in sorted(hit) if i - 1 not in hit]
        assert [len(x) for x in inside] == [next(n for n in range(1, len(w) + 1) if i + n not in hit) for i in runs]
        assert [x[0] for x in inside] == [w[i] for i in runs]


def test_own_columns_come_back(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = D.keep_clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert clean.columns == docs.columns
    assert sorted(map(str, clean.collect())) == sorted(str(r) for r in docs.collect() if not plain(r.text, tables()[1])[1])


@pytest.mark.parametrize("no_docs, no_items", [(True, False), (False, True), (True, True)])
def test_empty_tables(spark, folder, no_docs, no_items):
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    rows = D.scan(docs.where("false") if no_docs else docs, items.where("false") if no_items else items).collect()
    assert len(rows) == (0 if no_docs else len(tables()[0]))
    assert all(r.found.n_hit == 0 and r.found.spans == [] for r in rows)


def test_a_million_characters_and_many_empty_texts(spark):
    item = "one two three four five six seven eight nine ten eleven"
    text = "filler " * 150_000 + item.upper()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").unionAll(spark.range(100_000).selectExpr("id + 10 as doc_id", "if(id % 2 = 0, '', null) as text"))
    found = D.scan(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert found.where("found.n_hit > 0").selectExpr("row.doc_id", "found.n_hit", "found.n_words", "found.spans[0].start").collect() == [(1, 11, 150_011, 1_050_000)]
    assert found.count() == 100_001


def test_more_words_than_the_first_plane():
    """Item words beyond the surrogates get characters of their own."""
    many = [f"w{i}" for i in range(60_000)]
    machine = D.Automaton(["a"], [many])
    counts, coded = D.words_of(D.normalised(pa.array([" ".join(many[55_000:55_012]), "w1 w3", ""]).cast(pa.large_binary())))
    hit, row, item = machine.find(counts, coded)
    assert hit.tolist() == [True] * 12 + [False] * 2 and row.tolist() == [0] and item.tolist() == [0]
