"""Every registered query with SQL equals it on the smallest tables."""

import datetime
import math
from collections import Counter

import duckdb
import numpy as np
import pytest

from spanloom.plans import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    got = QUERIES[name](spark, DIR)
    want = db.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(map(_key, r)) for r in got.select(columns).collect()) == sorted(tuple(_key(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_cycle_split_scores_whole_rings(spark, db):
    rings = {}
    for ring, sig in db.sql("select label % 2, embedding from embeddings order by vec_id").fetchall():
        rings.setdefault(ring, []).append(np.array(sig, float))
    want = {}
    for ring, sig in rings.items():
        n = len(sig)
        least, w = max(30, round(n * 0.30)), max(5, min(12, n // 16))
        for k in range(max(least, round(n * 0.35)), min(n - least, round(n * 0.75)) + 1):
            if k + w < n:
                head = np.mean([np.abs(sig[i] - sig[k + i]).mean() for i in range(w)])
                tail = np.mean([np.abs(sig[n - w + i] - sig[k - w + i]).mean() for i in range(w)])
                want[ring, n, k] = (head + tail) / 2
    got = {(r.ring, r.n, r.split): r.score for r in QUERIES["cycle_split"](spark, DIR).collect()}
    assert set(got) == set(want) and len(want) > 120
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_connected_parts_has_all_orders(spark, tmp_path):
    # Customers 1 and 2 share a day only by an order of low priority; 3 has no order of high priority.
    rows = [(1, 1, "1995-01-01", "2-HIGH"), (2, 2, "1995-01-02", "2-HIGH"), (3, 1, "1995-01-02", "5-LOW"), (4, 3, "1996-01-01", "1-URGENT")]
    rows += [(100 + i, 10 + i * 7 % 40, f"1997-{1 + i * 5 % 12:02d}-{1 + i * 11 % 28:02d}", ("2-HIGH", "5-LOW")[i % 2]) for i in range(60)]
    o = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate string, o_orderpriority string").selectExpr("o_orderkey", "o_custkey", "date(o_orderdate) o_orderdate", "o_orderpriority")
    o.write.parquet(f"{tmp_path}/orders.parquet")
    root = {}
    edges = [(2 * c, 2 * (datetime.date.fromisoformat(d) - datetime.date(1990, 1, 1)).days + 1) for _, c, d, _ in rows]
    for u, v in edges:
        root[u], root[v] = u, v
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert {r.root: r.size for r in QUERIES["connected_parts"](spark, str(tmp_path)).collect()} == Counter(root.values())


def test_exactly_once_takes_every_line(spark, db):
    orders = {k for (k,) in db.sql("select o_orderkey from orders").fetchall()}
    lines = {k for (k,) in db.sql("select l_orderkey from lineitem").fetchall()}
    r = QUERIES["exactly_once"](spark, DIR).first()
    assert (r.n_expected, r.n_written, r.n_distinct, r.n_missing, r.n_unexpected, r.n_repeated) == (len(orders), len(lines), len(lines), len(orders - lines), len(lines - orders), 0)
