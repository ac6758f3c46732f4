"""Scores and the search for the best one, against plain computations."""

import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import similarity as S
from ledgerloom.operators import geometry as G
from ledgerloom.operators import mapping

WORDS = "date hotel adult total room number net cost egp arrival name no of the check in out guest a b".split()


def texts(n, seed, words=WORDS):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.5 and t:
            i = rnd.randrange(len(t))
            t = (t[:i] + rnd.choice("xyz ") + t[i + 1 :]).strip()
        out.append(t)
    return out


@pytest.mark.parametrize("scorer", [S.similarity, S.label_similarity, S.token_set_similarity])
def test_bounded_search_finds_what_a_full_one_finds(scorer):
    candidates = [(f"n{i}", c) for i, c in enumerate(texts(300, 1) + ["", "date", "date"])]
    matcher = S.Matcher(candidates, scorer)
    for text in texts(150, 2) + ["", "date", "zzzz", "é ü"]:
        best, top = None, 0.0
        for name, c in candidates:
            if (score := scorer(text, c)) > top:
                best, top = name, score
        assert matcher.best(text) == (best, top)
        bound = matcher.bounds(text)
        assert all(scorer(text, c) <= b + 1e-12 for (_, c), b in zip(candidates, bound, strict=True))


def test_ten_thousand_aliases_are_hardly_ever_scored():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9))) for _ in range(3000)]
    aliases = [(str(i), t) for i, t in enumerate(texts(10_000, 4, words))]
    matcher = S.Matcher(aliases)
    wanted = [t for _, t in rnd.sample(aliases, 40)]
    asked = [t[:-1] + "q" for t in wanted]
    for text in asked[:5]:
        top = max(S.similarity(text, t) for _, t in aliases)
        assert matcher.best(text)[1] == top
    matcher.scored = 0
    for text in asked:
        matcher.best(text)
    assert matcher.scored < 0.02 * len(asked) * len(aliases)


def test_token_sets():
    assert S.token_set_similarity("tour date", "date") == 1.0
    assert round(S.similarity("tour date", "date"), 3) == 0.615
    assert S.token_set_similarity("b a", "a b") == 1.0 and S.token_set_similarity("", "a") == 0.0
    assert S.token_set_similarity("abc", "abd") == pytest.approx(1 - 2 / 6)
    # shared "net", own "cost" and "total": the best of the rest's distance and the shared word with either's own.
    own = 1 - S.indel_distance("cost", "total") / (8 + 9)
    assert S.token_set_similarity("net cost", "total net") == pytest.approx(max(own, 6 / 11, 6 / 12))


def test_indel_distance():
    @lru_cache(None)
    def plain(a, b):
        return len(a) + len(b) if not a or not b else plain(a[1:], b[1:]) if a[0] == b[0] else 1 + min(plain(a[1:], b), plain(a, b[1:]))

    rnd = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 8))) for _ in range(2))
        assert S.indel_distance(a, b) == plain(a, b)


def test_the_mapper_takes_either_scorer(spark):
    heads = spark.createDataFrame([(1, 0, 0, "Tour Date"), (1, 0, 1, "zq")], "doc_id int, table_id int, col_idx int, header string")
    got = {scorer.__name__: [(r.standard_column, round(r.score, 3)) for r in mapping.map_columns(heads, columns=["Date"], threshold=0.9, scorer=scorer).orderBy("col_idx").collect()] for scorer in (S.similarity, S.token_set_similarity)}
    assert got["similarity"][0][0] is None and got["token_set_similarity"][0] == ("Date", 1.0)


def table(doc, rows=4, labels=("Date", "Hotel", "Total"), at=3.0):
    lines = [labels, *[(f"{r}", f"inn {r}", f"{r}0") for r in range(rows)]]
    return [(doc, 0, 10 * i + j, t, 20.0 + 150 * j, 30.0 * (i + at), 20.0 + 150 * j + 90, 30.0 * (i + at) + 18, 1.0, 600.0) for i, line in enumerate(lines) for j, t in enumerate(line) if t]


def test_turned_pages_come_back(spark):
    labels = spark.createDataFrame([("", n) for n in ("Date", "Hotel", "Total")], "supplier string, label string")
    upright = spark.createDataFrame(table("u") + table("blank text", labels=("", None, " ")), G.BOXES)
    boxes = upright.where("doc_id = 'u'")
    height = F.lit(500.0)
    sides = G.rotate(boxes, height).withColumn("doc_id", F.lit("c")).unionByName(G.rotate(boxes, height, clockwise=False).withColumn("doc_id", F.lit("w"))).select(*boxes.columns)
    pages = upright.withColumn("h", height).unionByName(sides.withColumn("h", F.lit(600.0)))
    got = G.upright(pages, F.col("h"), labels)
    assert got.columns == [*boxes.columns, "h", "turn"]
    rows = got.collect()
    at = lambda doc: sorted((r.box_id, r.x0, r.y0, r.x1, r.y1, r.page_width) for r in rows if r.doc_id == doc)
    assert at("u") == at("c") == at("w") and {(r.doc_id, r.turn) for r in rows} >= {("u", "none"), ("c", "counterclockwise"), ("w", "clockwise")}


def test_ties_stay_as_they_are(spark):
    """One box, or a page without any table, has no best way; pages of no boxes stay none."""
    labels = spark.createDataFrame([("", "Date")], "supplier string, label string")
    boxes = spark.createDataFrame([("one", 0, 0, "x", 10.0, 10.0, 20.0, 20.0, 1.0, 100.0), ("side", 0, 0, "x", 10.0, 10.0, 20.0, 90.0, 1.0, 100.0)], G.BOXES)
    got = G.upright(boxes, F.lit(100.0), labels).collect()
    assert {(r.doc_id, r.x0, r.y1, r.turn) for r in got} == {("one", 10.0, 20.0, "none"), ("side", 10.0, 90.0, "none")}
    assert G.upright(boxes.limit(0), F.lit(100.0), labels).collect() == []
