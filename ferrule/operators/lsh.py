"""MinHash signatures and banded buckets: candidates for set similarity."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions.scalars import linear_hash
from ferrule.operators import pairs

#: A prime just above 2^31; hash values are below it, so that products fit into 64 bits.
MODULUS = 2147483659


def hash_family(n: int, seed: int = 7, modulus: int = MODULUS) -> list[tuple[int, int]]:
    """n pairs (a, b) of multipliers and offsets, all different."""
    rng = random.Random(seed)
    out: dict[tuple[int, int], None] = {}
    while len(out) < n:
        out[(rng.randrange(1, modulus), rng.randrange(modulus))] = None
    return list(out)


def signatures(rows: DataFrame, key: str, item: str, hashes: list[tuple[int, int]], modulus: int = MODULUS, *, numbers: bool = False) -> DataFrame:
    """(key, sig): for each hash function, the least value over the key's items.

    Items are hashed to 31 bits first, unless they are `numbers` already."""
    base = rows.select(F.col(key).alias("key"), (F.col(item).cast("bigint") if numbers else F.pmod(F.xxhash64(item), F.lit(1 << 31))).alias("x"))
    # items are shuffled, not the least values that parts of a key have: these are as many numbers as there are hashes
    return base.repartition("key").groupBy("key").agg(F.array(*[F.min(linear_hash(F.col("x"), a, b, modulus)) for a, b in hashes]).alias("sig"))


def bands(sigs: DataFrame, n_rows: int) -> DataFrame:
    """(key, band, bucket): a bucket for every n_rows values of a signature."""
    return buckets(sigs, n_rows).select("key", F.posexplode("buckets").alias("band", "bucket"))


def buckets(sigs: DataFrame, n_rows: int) -> DataFrame:
    """(key, buckets): the bucket of each band, in an array."""
    n = F.size("sig") / n_rows
    return sigs.select("key", F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.xxhash64(F.slice("sig", i * n_rows + 1, n_rows))).alias("buckets"))


def sharing(found: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of `found` that share a bucket of some band; `placed` is what buckets() returns."""
    x, y = (placed.select(F.col("key").alias(k), F.col("buckets").alias(f"__{k}")) for k in "ab")
    both = found.join(x, "a").join(y, "b").where(F.exists(F.zip_with("__a", "__b", lambda p, q: p == q), lambda same: same))
    return both.select(*found.columns)


def candidates(banded: DataFrame) -> DataFrame:
    """(a, b): keys that share a bucket of some band, each pair once."""
    x, y = (banded.select("band", "bucket", F.col("key").alias(k)) for k in "ab")
    return x.join(y, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def similar(rows: DataFrame, key: str, item: str, *, n_hashes: int = 40, n_rows: int = 1, least: float = 0.05, seed: int = 7, numbers: bool = False) -> DataFrame:
    """(a, b, sim): keys whose sets are similar, of those that share a bucket.

    With one row a band, keys that share an item are candidates about as often as not, and verifying a candidate
    item by item costs as much as a whole set: common items of all pairs are counted instead, which takes one step
    each, and of the similar pairs those are kept that share a bucket.  With more rows, candidates are few, and are verified."""
    sigs = signatures(rows, key, item, hash_family(n_hashes, seed), numbers=numbers)
    if n_rows > 1:
        return pairs.verify(candidates(bands(sigs, n_rows)), rows, key, item, least)
    return sharing(pairs.jaccard(rows, key, item, least), buckets(sigs, n_rows)).select("a", "b", "sim")


def sql(rows: str, n_hashes: int, seed: int = 7) -> str:
    """Common table expressions, the last of them cand(a, b): keys of the query `rows` (key, x), x whole numbers, that share
    a bucket of one hash; for DuckDB."""
    least = ", ".join(f"min((x * {a} + {b}) % {MODULUS})" for a, b in hash_family(n_hashes, seed))
    return f"""sg AS (SELECT key, [{least}] AS sig FROM ({rows}) GROUP BY 1), bk AS (SELECT key, unnest(sig) AS v, generate_subscripts(sig, 1) AS band FROM sg),
        cand AS (SELECT DISTINCT x.key AS a, y.key AS b FROM bk x JOIN bk y ON x.band = y.band AND x.v = y.v AND x.key < y.key)"""
