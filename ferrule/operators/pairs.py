"""One engine for all pair similarities: ids that share items, with the moments of their common values.

Each item's keys stand in one sorted list, and each key of it is sent with the rest
of the list behind it, so that what meets a key meets in one task: pairs are made
and summed up there and never shuffled.  As many tasks are taken as there are PAIRS to
make.  An item of more than LIST keys is dealt out to pairs of shorter lists.  An item
of k ids still makes k (k - 1) / 2 pairs, so callers drop items that carry no
information first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.lineage import written

#: Keys of an item, or of a part of it, in one list.
LIST = 512
#: Pairs that a task makes, on average.
PAIRS = 1 << 20


def pairs(rows: DataFrame, key: str, item: str, value: str | None = None, least: int = 1, *, sized: bool = False) -> DataFrame:
    """(a, b, n) of keys with at least `least` common items; with a value, the sums sx, sy, sxx, syy, sxy too;
    `sized`, the numbers of rows na and nb that either has.

    (key, item) must be distinct."""
    base = rows.select(F.col(key).alias("k"), F.col(item).alias("i"), *([F.col(value).alias("v")] if value else []))
    if sized:
        # a key's size goes wherever the key goes
        base = base.withColumn("s", F.count("*").over(Window.partitionBy("k")).cast("int"))
    base = written(base.where("k is not null and i is not null"))
    carried = [c for c in ("v", "s") if c in base.columns]
    counts = base.groupBy("i").agg(F.count("*").alias("c")).where("c > 1")
    most, total = counts.agg(F.max("c"), F.sum(F.expr("c * (c - 1D) / 2"))).first()
    if most is None or most <= LIST:
        sent = _sent(base, carried)
    else:
        hot = counts.where(F.col("c") > LIST)
        sent = _sent(base.join(hot, "i", "left_anti"), carried).unionByName(_sent_of_hot(base.join(hot, "i"), carried))
    total = int(total or 0)
    tasks = max(1, -(-total // PAIRS), min(base.sparkSession.sparkContext.defaultParallelism, total >> 16))
    met = sent.repartition(tasks, "a").select("a", *[f"{c}a" for c in carried], F.explode(F.arrays_zip("b", *[f"{c}b" for c in carried])).alias("e"))
    met = met.select("a", F.col("e.b").alias("b"), *[F.col(f"{c}a") for c in carried], *[F.col(f"e.{c}b").alias(f"{c}b") for c in carried]).where("a < b")
    sums = {"sx": "va", "sy": "vb", "sxx": "va*va", "syy": "vb*vb", "sxy": "va*vb"} if value else {}
    ends = [F.max(f"s{k}").cast("bigint").alias(f"n{k}") for k in "ab"] if sized else []
    out = met.groupBy("a", "b").agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(c) for c, e in sums.items()], *ends)
    return out.where(F.col("n") >= least) if least > 1 else out


def _sent(base: DataFrame, carried: list[str]) -> DataFrame:
    """(a, b, and what is carried of a and of b): each key of an item, with an array of the greater ones."""
    lists = base.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("k", *carried))).alias("l")).where("size(l) > 1")
    lists = lists.select(F.col("l.k").alias("b"), *[F.col(f"l.{c}").alias(f"{c}b") for c in carried])
    each = lists.select("*", F.posexplode("b").alias("at", "a")).where("at < size(b) - 1")
    rest = [F.slice(c, F.col("at") + 2, F.size("b")).alias(c) for c in ("b", *[f"{c}b" for c in carried])]
    return each.select("a", *[F.get(f"{c}b", "at").alias(f"{c}a") for c in carried], *rest)


def _sent_of_hot(base: DataFrame, carried: list[str]) -> DataFrame:
    """The same of items with more keys than a list takes, given with their number c: any two of an item's parts make a list."""
    n = F.ceil(F.col("c") / (LIST // 2)).cast("int")
    dealt = base.withColumns({"n": n, "mine": F.pmod(F.xxhash64("k"), n).cast("int")}).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.withColumns({"p": F.least("mine", "o"), "q": F.greatest("mine", "o")})
    parts = max(1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lists = dealt.repartition(parts, "i", "p", "q").groupBy("i", "p", "q").agg(F.sort_array(F.collect_list(F.struct("k", *carried, "mine"))).alias("l"))
    each = lists.select("p", "q", "l", F.posexplode("l").alias("at", "e"))
    tail = F.slice("l", F.col("at") + 2, F.size("l"))
    # in a list of two parts, only what is across them
    each = each.select("e", F.when(F.col("p") == F.col("q"), tail).otherwise(F.filter(tail, lambda t: t["mine"] != F.col("e.mine"))).alias("t")).where("size(t) > 0")
    return each.select(F.col("e.k").alias("a"), *[F.col(f"e.{c}").alias(f"{c}a") for c in carried], F.col("t.k").alias("b"), *[F.col(f"t.{c}").alias(f"{c}b") for c in carried])


def sizes(rows: DataFrame, key: str, alias: str, count: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias(alias)).agg(F.count("*").alias(count))


def with_sizes(found: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Pairs with na and nb, the sizes of both item sets."""
    return found.join(sizes(rows, key, "a", "na"), "a").join(sizes(rows, key, "b", "nb"), "b")


def of_union() -> Column:
    """Common items by all items of either, from n, na and nb."""
    return F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))


def jaccard(rows: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """(a, b, sim): common items by all items of either."""
    return pairs(rows, key, item, sized=True).select("a", "b", of_union().alias("sim")).where(F.col("sim") >= least)


def set_cosine(rows: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """(a, b, sim): cosine of boolean profiles."""
    sim = F.col("n") / F.sqrt(F.col("na") * F.col("nb"))
    return pairs(rows, key, item, sized=True).select("a", "b", sim.alias("sim")).where(F.col("sim") >= least)


def cosine(rows: DataFrame, key: str, item: str, value: str, least_common: int, least: float) -> DataFrame:
    """(a, b, sim): cosine over common items."""
    sim = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    return pairs(rows, key, item, value, least_common).select("a", "b", sim.alias("sim")).where(F.col("sim") >= least)


def pearson_of_sums() -> Column:
    """Pearson's correlation from n and the five sums; null where either variance is 0."""
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    return F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy))


def pearson(rows: DataFrame, key: str, item: str, value: str, least_common: int = 3) -> DataFrame:
    """(a, b, n, w): correlation over common items, both means taken over these; only w > 0."""
    return pairs(rows, key, item, value, least_common).select("a", "b", "n", pearson_of_sums().alias("w")).where("w > 1e-9")


def verify(candidates: DataFrame, rows: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """Candidate pairs (a, b) whose exact Jaccard coefficient reaches `least`: (a, b, sim)."""
    xs = rows.select(F.col(key).alias("a"), F.col(item).alias("__i"))
    ys = rows.select(F.col(key).alias("b"), F.col(item).alias("__i"))
    common = candidates.join(xs, "a").join(ys, ["b", "__i"]).groupBy("a", "b").agg(F.count("*").alias("n"))
    return with_sizes(common, rows, key).select("a", "b", of_union().alias("sim")).where(F.col("sim") >= least)


def both_ways(found: DataFrame, *columns: str) -> DataFrame:
    """Pairs in both directions."""
    return found.select("a", "b", *columns).union(found.select(F.col("b"), F.col("a"), *columns))
