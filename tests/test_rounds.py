"""Iterative queries run as many rounds as the reference has."""

import os

import pytest

from ferrule.operators import cluster, hybrid
from ferrule.plans import graphs, recommend

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_kmeans_rounds(spark):
    want, _ = cluster.kmeans(graphs._points(spark, SF).select("idx", "attrs"), graphs.K, rounds=15, tolerance=0.01)
    assert {tuple(r) for r in graphs.kmeans(spark, SF).select("idx", "tag").collect()} == {tuple(r) for r in want.select("idx", "tag").collect()}


@pytest.mark.parametrize("query", [recommend.als_predict, recommend.hybrid_predict])
def test_als_rounds(spark, monkeypatch, query):
    class Trained(Exception):
        pass

    def als(**options):
        raise Trained(options["maxIter"])

    monkeypatch.setattr(hybrid, "ALS", als)
    with pytest.raises(Trained, match="^70$"):
        query(spark, SF)
