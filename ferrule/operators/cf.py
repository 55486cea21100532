"""Collaborative filtering: models of similar items and of similar users, and what they predict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.scalars import within
from ferrule.operators import lsh, pairs
from ferrule.operators.relational import keep_frequent, top_per_group


def item_model(ratings: DataFrame, least_raters: int = 3, least_common: int = 3) -> DataFrame:
    """(a, b, n, w): items with enough raters that go together."""
    return pairs.pearson(keep_frequent(ratings, "item", least_raters), "item", "user", "stars", least_common)


def user_model(ratings: DataFrame, *, n_hashes: int = 50, n_rows: int = 1, least_items: int = 3, least_common: int = 3, jaccard: float = 0.01, seed: int = 7, numbers: bool = False) -> DataFrame:
    """(a, b, n, w): users that go together, among those that share a MinHash bucket and enough items."""
    placed = lsh.buckets(lsh.signatures(ratings, "user", "item", lsh.hash_family(n_hashes, seed), numbers=numbers), n_rows)
    # sums of all pairs take one step an item in common; candidates, of which there are about as many, would take a set each
    rows = keep_frequent(ratings, "user", least_items)
    close = pairs.with_sizes(pairs.pearson(rows, "user", "item", "stars", least_common), rows, "user").where(pairs.of_union() >= jaccard)
    return lsh.sharing(close, placed).select("a", "b", "n", "w")


def exact_user_model(ratings: DataFrame, least_items: int = 3, least_common: int = 3) -> DataFrame:
    """The user model without the buckets: every pair of users with enough common items."""
    return pairs.pearson(keep_frequent(ratings, "user", least_items), "user", "item", "stars", least_common)


def predict_by_items(wanted: DataFrame, ratings: DataFrame, model: DataFrame, n: int = 3, least: int = 1) -> DataFrame:
    """(user, item, stars): the weighted mean of the user's ratings of the n items most like the wanted one.

    Pairs with fewer than `least` such items have no row."""
    like = pairs.both_ways(model, "w").select(F.col("a").alias("item"), F.col("b").alias("other"), "w")
    known = ratings.select("user", F.col("item").alias("other"), "stars")
    found = wanted.select("user", "item").distinct().join(known, "user").where("other <> item").join(like, ["item", "other"])
    best = top_per_group(found.withColumn("__w", F.round("w", 9)), ["user", "item"], n, "__w", "other")
    out = best.groupBy("user", "item").agg((F.sum(F.col("w") * F.col("stars")) / F.sum("w")).alias("stars"), F.count("*").alias("__n"))
    return out.where(F.col("__n") >= least).drop("__n")


def predict_by_users(wanted: DataFrame, ratings: DataFrame, model: DataFrame, n: int = 5) -> DataFrame:
    """(user, item, stars): the user's mean and the weighted mean of how the n most similar raters of the
    item put it against their other ratings; results that aren't stars (0 to 5) are left out."""
    totals = ratings.groupBy("user").agg(F.sum("stars").alias("s"), F.count("*").alias("c"))
    like = pairs.both_ways(model, "w").select(F.col("a").alias("user"), F.col("b").alias("other"), "w")
    raters = ratings.select(F.col("user").alias("other"), "item", "stars").join(totals.withColumnRenamed("user", "other"), "other")
    # a rater of this item alone has no other ratings to hold it against
    raters = raters.where("c > 1").select("other", "item", (F.col("stars") - (F.col("s") - F.col("stars")) / (F.col("c") - 1)).alias("gap"))
    found = wanted.select("user", "item").distinct().join(raters, "item").where("other <> user").join(like, ["user", "other"])
    best = top_per_group(found.withColumn("__w", F.round("w", 9)), ["user", "item"], n, "__w", "other")
    shift = best.groupBy("user", "item").agg((F.sum(F.col("w") * F.col("gap")) / F.sum("w")).alias("shift"))
    stars = within(F.col("s") / F.col("c") + F.col("shift"), 0, 5)
    return shift.join(totals, "user").select("user", "item", stars.alias("stars")).where("stars is not null")
