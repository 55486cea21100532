"""Every query against its SQL twin in DuckDB, and what the others must at least be."""

import math
import os

import duckdb
import pytest

from ferrule.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    want = db.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


def _frame(spark, name):
    return catalogue.queries()[name](spark, SF)


def _count(db, sql):
    return db.execute(sql).fetchone()[0]


_HELD = 'SELECT DISTINCT o_custkey AS "user", l_partkey AS item FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE (o_custkey + l_partkey) % 50 = 0'


@pytest.mark.parametrize("name", ["als_predict", "als_centred", "hybrid_predict"])
def test_predictions(spark, db, name):
    """One for each held-out pair; of the blend, all known and within the scale."""
    rows = _frame(spark, name).collect()
    assert {(r.user, r.item) for r in rows} == set(db.execute(_HELD).fetchall()) and len(rows) == _count(db, f"SELECT count(*) FROM ({_HELD})")
    if name == "hybrid_predict":
        assert all(0 <= r.stars <= 5 for r in rows)


def test_thresholds_are_sorted(spark):
    errors = [r.rmse for r in _frame(spark, "als_thresholds").collect()]
    assert errors == sorted(errors) and len(errors) == 4 and 0 < errors[0] < 4


def test_clusterings_conserve_points(spark, db):
    n = _count(db, "SELECT count(*) FROM embeddings")
    for name in ("kmeans", "bfr"):
        rows = _frame(spark, name).collect()
        assert len(rows) == len({r.idx for r in rows}) == n
    stats = _frame(spark, "bfr_round_stats").orderBy("round").collect()
    assert stats[-1].discard_points + stats[-1].compressed_points + stats[-1].retained_points == n


def test_girvan_newman_covers_the_graph(spark):
    # the graph of sf0.01 has 188 edges, that of sf0.001, of fewer customers, 4,906: many minutes
    rows, degrees = (catalogue.queries()[name](spark, "/root/testdata/sf0.01").collect() for name in ("girvan_newman", "graph_degree"))
    assert {r.id for r in rows} == {r.id for r in degrees} and len(rows) == len(degrees)


def test_clustered_estimates(spark, db):
    got = {r.day: r.estimate for r in _frame(spark, "fm_clusters").collect()}
    want = {d: n for d, n in db.execute("SELECT CAST(ts AS DATE), count(DISTINCT user_id) FROM events GROUP BY 1").fetchall()}
    assert got.keys() == want.keys()
    near = sorted(got[d] / want[d] for d in want)
    assert 0.2 < near[len(near) // 2] < 5


def test_physical_partitions(spark, db):
    rows = _frame(spark, "physical_partitions").collect()
    assert rows and all(v is not None for r in rows for v in r)


def test_nothing_else_lacks_sql():
    known = {"als_predict", "als_centred", "hybrid_predict", "als_thresholds", "kmeans", "bfr", "bfr_round_stats", "girvan_newman", "fm_clusters", "physical_partitions"}
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == known
