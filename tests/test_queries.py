"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import difflib
import math
import os

import pytest

from ledgerloom.plans import batches, routes  # noqa: F401  register their queries
from ledgerloom.plans import queries as Q

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = Q.QUERIES[name](spark, SF)
    want = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_difflib_scores(spark):
    """The best of difflib's ratio, containment by length and shared words, worked out here."""

    def plain(a, b):
        left, right = set(a.split()), set(b.split())
        inside = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
        return 1.0 if a == b else max(difflib.SequenceMatcher(None, a, b).ratio(), inside, len(left & right) / max(len(left), len(right)))

    rows = Q.fuzzy_difflib(spark, SF).collect()
    assert rows and all(abs(r.score - plain(r.a, r.b)) < 1e-12 for r in rows)
