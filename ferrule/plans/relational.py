"""Counts, top-k lists, joins and averages over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions.text import split_words
from ferrule.operators import relational as R
from ferrule.sources.tables import table

#: A short list of stopwords.
STOPWORDS = ("a", "and", "der", "de", "in", "is", "la", "of", "the", "to")


def count_year_distinct(spark, d):
    """All orders, those of 1997, and distinct customers of either."""
    o = table(spark, d, "orders").select("o_custkey", (F.year("o_orderdate") == 1997).alias("y"))
    return o.agg(F.count("*").alias("n"), F.count_if("y").alias("n_year"), F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.when(F.col("y"), F.col("o_custkey"))).alias("customers_year"))


def top_users(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return R.top(counts, 10, "n", "o_custkey")


def top_words(spark, d):
    words = table(spark, d, "documents").select(F.explode(split_words(F.col("text"))).alias("word")).where(~F.col("word").isin(*STOPWORDS))
    return R.top(words.groupBy("word").agg(F.count("*").alias("n")), 20, "n", "word")


def category_avg_topk(spark, d):
    """Average stars of each word of the part type, best first (A.1)."""
    words = table(spark, d, "part").select(F.col("p_partkey").alias("item"), F.explode(F.split("p_type", " ")).alias("category"))
    stars = table(spark, d, "lineitem").select(F.col("l_partkey").alias("item"), (1 + F.col("l_quantity").cast("int") % 5).alias("stars"))
    averages = R.average_through(words, stars, "item", "category", "stars", "avg_stars")
    return R.top(averages, 10, "avg_stars", "category").select("category", F.round("avg_stars", 6).alias("avg_stars"))


def having_threshold(spark, d):
    return R.having_at_least(table(spark, d, "lineitem"), ["l_suppkey"], 610)


def partition_stats(spark, d):
    return R.bucket_sizes(table(spark, d, "lineitem"), "l_partkey", 27)


def physical_partitions(spark, d):
    """Rows of the partitions that hashing the part key into 7 makes; how many a partition has is the engine's affair."""
    return R.partition_sizes(table(spark, d, "lineitem").select("l_partkey").repartition(7, "l_partkey"))


def filtered_join_pairs(spark, d):
    """Customers of one nation with their orders."""
    c = table(spark, d, "customer").where("c_nationkey = 7").select("c_custkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


def max_and_first_per_user(spark, d):
    """Greatest order and day of the last order of each customer."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("greatest"), F.max("o_orderdate").cast("date").alias("last_day"))


def user_item_max(spark, d):
    """Highest stars of each customer and part, where an order line gives several."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (1 + F.col("l_quantity").cast("int") % 5).alias("stars"))
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy("o_custkey", "l_partkey").agg(F.max("stars").alias("stars"))


def top_items_per_user(spark, d):
    """The three dearest orders of each customer."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.top_per_group(o, ["o_custkey"], 3, "o_totalprice", "o_orderkey")


def id_universe(spark, d):
    """Numbers from 0 on for all part keys that occur anywhere."""
    ids = R.universe(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").select("l_partkey"))
    return R.dictionary(ids, "id")


def never_ordered(spark, d):
    """Customers without an order."""
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def median_price(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.median("o_totalprice"), 4).alias("median_price"))


def json_props(spark, d):
    """Sum of the key k of the JSON column of events by type."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (count_year_distinct, top_users, top_words, category_avg_topk, having_threshold, partition_stats, physical_partitions, filtered_join_pairs, max_and_first_per_user, user_item_max, top_items_per_user, id_universe, never_ordered, median_price, json_props)}

_WORDS = r"unnest(regexp_split_to_array(lower(text), '[\(\[,.!?:;\]\)\s]'))"
SQL = {
    "count_year_distinct": "SELECT count(*) AS n, count(*) FILTER (WHERE year(o_orderdate) = 1997) AS n_year, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_custkey) FILTER (WHERE year(o_orderdate) = 1997) AS customers_year FROM orders",
    "top_users": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10",
    "top_words": f"SELECT word, count(*) AS n FROM (SELECT {_WORDS} AS word FROM documents) WHERE word <> '' AND word NOT IN {STOPWORDS} GROUP BY 1 ORDER BY n DESC, word LIMIT 20",
    "category_avg_topk": """
        WITH w AS (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS category FROM part),
        r AS (SELECT l_partkey, sum(1 + CAST(l_quantity AS INT) % 5) AS s, count(*) AS c FROM lineitem GROUP BY 1)
        SELECT category, round(CAST(sum(s) AS DOUBLE) / CAST(sum(c) AS DOUBLE), 6) AS avg_stars
        FROM w JOIN r ON p_partkey = l_partkey GROUP BY category
        ORDER BY CAST(sum(s) AS DOUBLE) / CAST(sum(c) AS DOUBLE) DESC, category LIMIT 10""",
    "having_threshold": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 610",
    "partition_stats": "SELECT b AS bucket, count(l_partkey) AS n_items FROM range(27) t(b) LEFT JOIN lineitem ON ((l_partkey % 27) + 27) % 27 = b GROUP BY b",
    "filtered_join_pairs": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7",
    "max_and_first_per_user": "SELECT o_custkey, max(o_totalprice) AS greatest, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1",
    "user_item_max": "SELECT o_custkey, l_partkey, max(1 + CAST(l_quantity AS INT) % 5) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "top_items_per_user": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "id_universe": 'SELECT id, row_number() OVER (ORDER BY id) - 1 AS "index" FROM (SELECT p_partkey AS id FROM part UNION SELECT l_partkey FROM lineitem)',
    "never_ordered": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "median_price": "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median_price FROM orders GROUP BY 1",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
}
