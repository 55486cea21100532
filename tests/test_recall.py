"""Queries that search by candidates, against the exact ones."""

import os

from ferrule.plans import mining, recommend

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_minhash_finds_most_pairs(spark):
    exact = {(r.a, r.b): r.sim for r in mining.jaccard_pairs(spark, SF).collect()}
    got = {(r.a, r.b): r.sim for r in mining.minhash_similar(spark, SF).collect()}
    assert got.items() <= exact.items()
    assert len(got) > 0.9 * len(exact)


def test_user_buckets_find_most_pairs(spark):
    exact = {(r.a, r.b): r.w for r in recommend.pearson_user_model(spark, SF).collect()}
    got = {(r.a, r.b): r.w for r in recommend.lsh_user_model(spark, SF).collect()}
    assert got.items() <= exact.items()
    assert len(got) > 0.9 * len(exact) > 0


def test_half_of_what_augmenting_knows_is_blended(spark):
    """On a frame where users with few ratings want items like those that they rated."""
    from ferrule.operators import hybrid

    ratings = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u in range(40) for i in range(12) if (i % 4 != u % 4) and (u % 2 or i < 8)], "user long, item long, stars double")
    like = spark.createDataFrame([(a, b, 0.8) for a in range(12) for b in range(a + 1, 12)], "a long, b long, sim double")
    wanted = spark.createDataFrame([(u, i) for u in range(0, 40, 2) for i in range(12) if i % 4 == u % 4], "user long, item long")
    averages = ratings.groupBy("item").agg({"stars": "avg"}).withColumnRenamed("avg(stars)", "average")
    more = hybrid.augment(ratings, like, averages, hybrid.overall(ratings))
    model = hybrid.train_als(ratings.union(more.select("user", "item", "stars")), least_user=1, least_item=1, rounds=3)
    factors = hybrid.predict_factors(model, wanted)
    both = wanted.join(more, ["user", "item"]).join(factors.where("als is not null and not isnan(als)"), ["user", "item"]).count()
    assert 2 * both > wanted.count()
    assert hybrid.blend(wanted, more, factors, averages, 0.0).where("stars between 0 and 5").count() == wanted.count()
