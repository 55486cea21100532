"""Readers of the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (user, item): the mean of the stars its order lines give.

    Stars are whole numbers from 1 to 5, so that sums are exact.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("item"),
        (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("stars"),
    )
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    return joined.groupBy("user", "item").agg((F.sum("stars") / F.count("*")).alias("stars"))
