"""Grouping, top-k lists, set operations and partition figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average_by(rows: DataFrame, keys: list[str], value: str, alias: str = "average") -> DataFrame:
    """Sum by count of a value a key: additive, so that partial results can be added up first."""
    return rows.groupBy(*keys).agg((F.sum(value) / F.count(value)).alias(alias))


def average_through(left: DataFrame, right: DataFrame, on: str, group: str, value: str, alias: str = "average") -> DataFrame:
    """The average of right's values over the groups of left, with right summed up a key before the join."""
    per_key = right.groupBy(on).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    joined = left.join(per_key, on)
    return joined.groupBy(group).agg((F.sum("__s") / F.sum("__c")).alias(alias))


def top(rows: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    """The n rows with the greatest `by`; ties in the order of other columns."""
    return rows.orderBy(F.desc(by), *ties).limit(n)


def top_per_group(rows: DataFrame, group: list[str], n: int, by: str, *ties: str) -> DataFrame:
    """The n rows of each group with the greatest `by`."""
    w = Window.partitionBy(*group).orderBy(F.desc(by), *ties)
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def top_levels(counts: DataFrame, levels: int, count: str = "count") -> DataFrame:
    """Rows whose count is among the greatest `levels` different counts, all ties included.

    Only the different counts are ranked, not the rows."""
    best = counts.select(count).distinct().orderBy(F.desc(count)).limit(levels)
    ranked = best.withColumn("level", F.dense_rank().over(Window.orderBy(F.desc(count))))
    return counts.join(F.broadcast(ranked), count)


def values_by_count(counts: DataFrame, value: str, count: str = "count") -> DataFrame:
    """For each count, the sorted values that have it."""
    return counts.groupBy(count).agg(F.sort_array(F.collect_list(value)).alias("values"))


def having_at_least(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Groups of at least so many rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def keep_frequent(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Rows whose key has at least so many rows."""
    return rows.join(having_at_least(rows, [key], least).select(key), key, "left_semi").select(*rows.columns)


def drop_rare(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Rows none of whose keys has fewer rows than its limit; all counts are taken before anything is dropped."""
    out = rows
    for key, least in limits.items():
        rare = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < least).select(key)
        out = out.join(rare, key, "left_anti")
    return out.select(*rows.columns)


def universe(*columns: DataFrame) -> DataFrame:
    """The distinct values of one-column frames."""
    out = columns[0].toDF("id")
    for c in columns[1:]:
        out = out.union(c.toDF("id"))
    return out.distinct()


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """(column, index): a number from 0 on for each distinct value, in the values' order.

    Values are sorted over all partitions and each partition counts on from the ones before it, so that no
    task sees all of them."""
    spark = values.sparkSession
    ordered = values.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
    ordered = ordered.withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id())
    from ferrule.operators.lineage import cut

    ordered = cut(ordered)
    sizes = {r["__p"]: r["n"] for r in ordered.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    starts = spark.createDataFrame(rows or [(0, 0)], "__p int, __s bigint")
    place = F.col("__m") - F.shiftleft(F.col("__p").cast("bigint"), 33)
    return ordered.join(F.broadcast(starts), "__p").select(column, (place + F.col("__s")).alias("index"))


def partition_sizes(rows: DataFrame) -> DataFrame:
    """Rows of each physical partition, empty ones included."""
    n = rows.rdd.getNumPartitions()
    counts = rows.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_items"))
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("partition")).join(counts, "partition", "left").fillna(0, ["n_items"])


def bucket_sizes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of each of n key buckets, empty ones included; never negative, whatever the key."""
    counts = rows.groupBy(F.pmod(F.col(key), F.lit(n)).cast("bigint").alias("bucket")).agg(F.count("*").alias("n_items"))
    return rows.sparkSession.range(n).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").fillna(0, ["n_items"])
