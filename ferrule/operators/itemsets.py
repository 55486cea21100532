"""Frequent itemsets: level by level, by hashed pair counts, and by partitions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators.lineage import cut, written

#: Baskets that a task mines at a time.
STRETCH = 50_000


def baskets(rows: DataFrame, key: str, item: str, more_than: int = 0) -> DataFrame:
    """(basket, item), distinct, of baskets with more than so many items."""
    out = rows.select(F.col(key).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null").distinct()
    if more_than:
        big = out.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("basket")
        out = out.join(big, "basket", "left_semi")
    return out


def singles(rows: DataFrame, support: int) -> DataFrame:
    """(items, support) of frequent items, as arrays of one."""
    return rows.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support).select(F.array("item").alias("items"), "support")


def extend(level: DataFrame) -> DataFrame:
    """Candidates one longer: sets that differ in the last item only are joined, and those with an infrequent subset dropped."""
    a = level.select(F.expr("slice(items, 1, size(items) - 1)").alias("head"), F.element_at("items", -1).alias("x"))
    b = a.select("head", F.col("x").alias("y"))
    grown = a.join(b, "head").where("x < y").select(F.concat("head", F.array("x", "y")).alias("items"))
    subsets = grown.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.size("items")), lambda i: F.concat(F.slice("items", F.lit(1), i - 1), F.slice("items", i + 1, F.size("items"))))).alias("subset"))
    known = subsets.join(level.select(F.col("items").alias("subset")), "subset", "left_semi")
    return known.groupBy("items").agg(F.count("*").alias("k")).where(F.col("k") == F.size("items")).select("items")


def occurrences(rows: DataFrame, before: DataFrame | None, candidates: DataFrame | None) -> DataFrame:
    """(basket, items): sets one longer than those of `before`, in the baskets that hold them.

    A set grows by the greater items of its own basket, so only what occurs together is ever made."""
    if before is None:
        grown = rows.select("basket", F.array("item").alias("items"))
    else:
        grown = before.join(rows, "basket").where(F.col("item") > F.element_at("items", -1)).select("basket", F.concat("items", F.array("item")).alias("items"))
    return grown if candidates is None else grown.join(candidates.select("items"), "items", "left_semi")


def grown(held: DataFrame) -> DataFrame:
    """(basket, items): sets one longer, each of two that differ in the last item only and stand in the same basket.

    `held` has the frequent sets of every basket, so no more is made than baskets hold; candidates of frequent sets
    that never occur together, of which there may be many more, aren't."""
    a = held.select("basket", F.expr("slice(items, 1, size(items) - 1)").alias("head"), F.element_at("items", -1).alias("x"))
    b = a.select("basket", "head", F.col("x").alias("y"))
    return a.join(b, ["basket", "head"]).where("x < y").select("basket", F.concat("head", F.array("x", "y")).alias("items"))


def count(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """(items, support): in how many baskets each candidate is contained.  All subsets of a candidate must be candidates."""
    out, held = None, None
    longest = candidates.agg(F.max(F.size("items"))).first()[0] or 1
    for size in range(1, longest + 1):
        held = cut(occurrences(rows, held, candidates.where(F.size("items") == size)))
        part = held.groupBy("items").agg(F.count("*").alias("support"))
        out = part if out is None else out.unionByName(part)
    return out


def levels(rows: DataFrame, support: int, longest: int | None = None, pairs: DataFrame | None = None) -> Iterator[DataFrame]:
    """Frequent itemsets of 1, 2, ... items.  Baskets are reduced to frequent items; a level of none ends it.

    `pairs`, if given, are the frequent pairs, found in another way."""
    level = cut(singles(rows, support))
    reduced = cut(rows.join(level.select(F.col("items")[0].alias("item")), "item", "left_semi").select("basket", "item"))
    held, size = occurrences(reduced, None, None), 1
    while level.limit(1).count():
        yield level
        size += 1
        if longest and size > longest:
            return
        # pairs of frequent items need no candidates: both of their subsets are frequent
        made = cut(occurrences(reduced, held, pairs) if size == 2 else grown(held))
        level = cut(made.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support))
        held = made.join(level.select("items"), "items", "left_semi")


def frequent(rows: DataFrame, support: int, longest: int | None = None) -> DataFrame:
    """(items, support) of all frequent itemsets, or of those up to a length; items ascend."""
    out = singles(rows, support)
    for level in itertools.islice(levels(rows, support, longest), 1, None):
        out = out.unionByName(level)
    return out


def of_size(rows: DataFrame, support: int, size: int) -> DataFrame:
    """(items, support) of the frequent itemsets of one size; longer ones aren't looked for."""
    found = list(levels(rows, support, size))
    return found[size - 1] if len(found) >= size else singles(rows, support).limit(0)


def pair_buckets(rows: DataFrame, buckets: int = 1000) -> DataFrame:
    """(bucket, n): how many pairs of whole-numbered items fall into each bucket, x * y modulo `buckets`."""
    a, b = (rows.select("basket", F.col("item").alias(n)) for n in "xy")
    return a.join(b, "basket").where("x < y").groupBy(F.pmod(F.col("x") * F.col("y"), F.lit(buckets)).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def hashed_pairs(rows: DataFrame, support: int, buckets: int = 1000) -> DataFrame:
    """Frequent pairs by two passes: pairs of frequent items in frequent buckets only are counted one by one."""
    heavy = pair_buckets(rows, buckets).where(F.col("n") >= support).select("bucket")
    reduced = rows.join(singles(rows, support).select(F.col("items")[0].alias("item")), "item", "left_semi")
    a, b = (reduced.select("basket", F.col("item").alias(n)) for n in "xy")
    made = a.join(b, "basket").where("x < y").withColumn("bucket", F.pmod(F.col("x") * F.col("y"), F.lit(buckets)).cast("bigint"))
    counted = made.join(F.broadcast(heavy), "bucket", "left_semi").groupBy("x", "y").agg(F.count("*").alias("support"))
    return counted.where(F.col("support") >= support).select(F.array("x", "y").alias("items"), "support")


def frequent_by_buckets(rows: DataFrame, support: int, buckets: int = 1000) -> DataFrame:
    """All frequent itemsets of whole-numbered items, the pairs by hashed pair counts, longer ones from these."""
    rows = written(rows)
    out = None
    for level in levels(rows, support, pairs=cut(hashed_pairs(rows, support, buckets))):
        out = level if out is None else out.unionByName(level)
    return singles(rows, support) if out is None else out


def _local(baskets_: list[frozenset], support: int) -> set[tuple]:
    """Frequent itemsets of some baskets, by intersecting lists of basket numbers."""
    where: dict[tuple, set[int]] = {}
    for i, basket in enumerate(baskets_):
        for x in basket:
            where.setdefault((x,), set()).add(i)
    where = {k: v for k, v in where.items() if len(v) >= support}
    found = set(where)
    one = dict(where)
    while where:
        nxt: dict[tuple, set[int]] = {}
        for head, ids in where.items():
            for (x,), other in one.items():
                if x > head[-1]:
                    both = ids & other
                    if len(both) >= support and all(s in where for s in combinations((*head, x), len(head))):
                        nxt[(*head, x)] = both
        found |= set(nxt)
        where = nxt
    return found


def partition_candidates(rows: DataFrame, support: int, partitions: int, stretch: int = STRETCH) -> DataFrame:
    """Itemsets that are frequent in some stretch of baskets, each held to its share of the support.

    A task goes through its baskets in stretches of `stretch`, so that it never holds more than two; the share of a
    stretch of b of all n baskets is ceil(support * b / n).  Whatever is frequent in all baskets is frequent in
    one of the stretches, so nothing is missed."""
    kind = rows.schema["item"].dataType.simpleString()
    whole = cut(rows.groupBy("basket").agg(F.collect_list("item").alias("items")).repartition(partitions, "basket").select("items"))
    n = max(1, whole.count())

    def local(batches):
        held: list[frozenset] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held += [frozenset(x) for x in batch["items"]]
            # the rest is mined with the last whole stretch, as a few baskets alone would make all of their subsets
            while len(held) >= 2 * stretch or (batch is None and held):
                part, held = (held[:stretch], held[stretch:]) if len(held) >= 2 * stretch else (held, [])
                found = _local(part, -(-support * len(part) // n))
                yield pd.DataFrame({"items": [list(x) for x in found]})

    return whole.mapInPandas(local, f"items array<{kind}>").distinct()


def by_partitions(rows: DataFrame, support: int, partitions: int | None = None) -> DataFrame:
    """Frequent itemsets in two phases: candidates of partitions, then exact counts.  Without a number of partitions,
    as many as the session shuffles to."""
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = cut(partition_candidates(rows, support, partitions))
    return count(candidates, rows).where(F.col("support") >= support)


def report_lines(sets: DataFrame) -> DataFrame:
    """(size, line): itemsets of each size as one line, ('a'),('b') or ('a', 'b'), items and sets in string order."""
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    texts = sets.select(F.size("items").alias("size"), names.alias("names"))
    quoted = F.concat(F.lit("('"), F.array_join("names", "', '"), F.lit("')"))
    lines = texts.groupBy("size").agg(F.sort_array(F.collect_list(F.struct("names", quoted.alias("q")))).alias("l"))
    return lines.select("size", F.array_join(F.col("l.q"), ",").alias("line"))
