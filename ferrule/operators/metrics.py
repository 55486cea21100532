"""How good predictions, labels and filters are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(rmse, n, n_missing): over rows with a prediction."""
    gap = F.col(truth) - F.col(predicted)
    return rows.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.count(gap).alias("n"), F.count_if(F.col(predicted).isNull()).alias("n_missing"))


def error_histogram(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(bin, n): absolute errors from 0, 1, 2, 3 and from 4 on."""
    gap = F.abs(F.col(truth) - F.col(predicted))
    # least() passes over nulls, so rows without a prediction go first
    return rows.where(gap.isNotNull()).groupBy(F.least(F.floor(gap), F.lit(4)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def sparsity(ratings: DataFrame) -> DataFrame:
    """(sparsity): the share of the user by item matrix without a rating, a row being one."""
    n = ratings.agg(F.count("*").alias("n"), F.count_distinct("user").alias("u"), F.count_distinct("item").alias("i"))
    return n.select((1 - F.col("n") / (F.col("u") * F.col("i"))).alias("sparsity"))


def filter_quality(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """(fpr, fnr) of a yes-or-no filter; null where there is nothing to get wrong."""
    t, s = F.col(truth), F.col(said)
    return rows.agg(F.try_divide(F.count_if(~t & s), F.count_if(~t)).alias("fpr"), F.try_divide(F.count_if(t & ~s), F.count_if(t)).alias("fnr"))


def nmi(rows: DataFrame, a: str, b: str, average: str = "geometric") -> DataFrame:
    """(nmi): mutual information of two labelings by the geometric or arithmetic mean of their entropies; 1 where both have one label only."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("t"))
    na, nb = (cells.groupBy(k).agg(F.sum("n").alias(f"n{k}")) for k in "ab")

    def entropy(counts, column):
        p = F.col(column) / F.col("t")
        return counts.crossJoin(total).agg((-F.sum(p * F.log(p))).alias(f"h_{column}"))

    joint = cells.join(na, "a").join(nb, "b").crossJoin(total)
    info = joint.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("i"))
    both = info.crossJoin(entropy(na, "na")).crossJoin(entropy(nb, "nb"))
    mean = F.sqrt(F.col("h_na") * F.col("h_nb")) if average == "geometric" else (F.col("h_na") + F.col("h_nb")) / 2
    return both.select(F.when((F.col("h_na") == 0) & (F.col("h_nb") == 0), F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("i"), mean), F.lit(0.0))).alias("nmi"))
