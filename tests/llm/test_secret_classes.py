import random
import string

from ledgerloom.llm import secrets as S

ALPHABETS = {
    "hex": "0123456789ABCDEF",
    "lower": string.ascii_lowercase + string.digits,
    "upper": string.ascii_uppercase + string.digits,
    "base32": string.ascii_uppercase + "234567",
    "base62": string.ascii_letters + string.digits,
}


def test_random_secrets_of_narrow_alphabets_are_found(spark):
    """Of random strings with a digit and a letter at most a few in a hundred are missed, down to 16 characters."""
    rnd, rows = random.Random(2), []
    for name, alphabet in ALPHABETS.items():
        for n in (16, 20, 24, 32):
            while sum(r[0] == f"{name} {n}" for r in rows) < 60:
                s = "".join(rnd.choice(alphabet) for _ in range(n))
                if any(c.isdigit() for c in s) and any(c.isalpha() for c in s):
                    rows.append((f"{name} {n}", f"we keep {s} here"))
    found = S.find_secrets(spark.createDataFrame(rows, "doc_id string, text string")).selectExpr("doc_id", "size(added_spans) > 0 as hit").groupBy("doc_id").agg({"hit": "count_if"}).collect()
    assert len(found) == 20 and all(r[1] >= 56 for r in found), found


def test_rest_beside_a_base_span_is_judged(spark):
    key, rest = "AKIA" + "ABCDEFGHIJ234567", "Zx9kQ2mV7tLp4RsW8yBn3Hc1"
    texts = [f"{key}/{rest}", f"{rest}/{key}", f"{rest}/{key}/{rest}"]
    rows = {r.doc_id: r for r in S.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        assert [t[x.start : x.end] for x in rows[i].base_spans] == [key]
        assert [t[x.start : x.end] for x in rows[i].added_spans] == [t]


def test_common_identifiers_are_left(spark):
    words = "internationalization2024 a-few-dashed-words-2024 some_very_long_function_name plainlongwordwithoutdigits"
    assert S.find_secrets(spark.createDataFrame([(1, words)], "doc_id int, text string")).first().added_spans == []
