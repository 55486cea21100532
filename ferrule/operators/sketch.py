"""Sketches over batches: Bloom filter, Flajolet-Martin distinct counts, reservoir samples."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.scalars import linear_hash, trailing_zeros, utf8_mod

#: Modulus of the strings' numbers, below which hash products fit into 64 bits.
NUMBERS = 2147483647
#: Flajolet-Martin: modulus of the hashes, how many, and how many share a group.
FM_MODULUS, FM_HASHES, FM_GROUP = (1 << 20) - 1, 30, 3


def hash_parameters(n: int, modulus: int, seed: int = 11) -> list[tuple[int, int]]:
    """n different pairs (a, b), in a fixed order."""
    rng = random.Random(seed)
    out: dict[tuple[int, int], None] = {}
    while len(out) < n:
        out[(rng.randrange(1, modulus), rng.randrange(modulus))] = None
    return list(out)


def numbered(rows: DataFrame, value: str, modulus: int, name: str = "__x") -> DataFrame:
    """`rows` with a string's number, null for null and the empty string: a column of its own, so that many
    hashes of it don't each work it out again."""
    return rows.withColumn(name, F.when(F.col(value) != "", utf8_mod(F.col(value), modulus)))


def bloom_positions(x, bits: int = 30_000, n_hashes: int = 20, seed: int = 11) -> Column:
    """The positions that a number sets; none for null."""
    at = F.array_distinct(F.array(*[linear_hash(x, a, b, bits) for a, b in hash_parameters(n_hashes, bits, seed)]))
    return F.when(x.isNotNull(), at).otherwise(F.array().cast("array<bigint>"))


def bloom_bits(values: DataFrame, column: str, bits: int = 30_000, n_hashes: int = 20, seed: int = 11) -> DataFrame:
    """(position): the set bits of a filter of some strings; at most `bits` rows, whatever the input."""
    numbers = numbered(values.select(column).distinct(), column, NUMBERS)
    return numbers.select(F.explode(bloom_positions(F.col("__x"), bits, n_hashes, seed)).alias("position")).distinct()


def bloom_probe(values: DataFrame, column: str, filled: DataFrame, bits: int = 30_000, n_hashes: int = 20, seed: int = 11) -> DataFrame:
    """`values` with `seen`, 1 if all positions of the string are set, 0 for null and the empty string.

    The filter is one row of `bits` bits, 64 a number, so it is broadcast, and a look at a position is one step."""
    words = filled.groupBy(F.shiftright("position", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(position & 63 as int))")).alias("b"))
    known = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
    one = known.select(F.transform(F.sequence(F.lit(0), F.lit((bits - 1) // 64)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("__bits"))
    at = bloom_positions(F.col("__x"), bits, n_hashes, seed)
    probed = numbered(values, column, NUMBERS).withColumn("__at", at).crossJoin(F.broadcast(one))
    hit = (F.size("__at") > 0) & F.forall("__at", lambda p: F.getbit(F.get("__bits", F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return probed.withColumn("seen", hit.cast("int")).drop("__bits", "__at", "__x")


def fm_levels(x, n_hashes: int = FM_HASHES, modulus: int = FM_MODULUS, seed: int = 23) -> list[Column]:
    """Trailing zeros of each hash of a number."""
    return [trailing_zeros(linear_hash(x, a, b, modulus)) for a, b in hash_parameters(n_hashes, modulus, seed)]


def fm_estimate(levels) -> Column:
    """The estimate from the greatest trailing zeros of each hash: median of groups' means of powers of two, ties to even."""
    powers = F.transform(levels, lambda r: F.pow(F.lit(2.0), r))
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size(levels) / FM_GROUP).cast("int") - 1), lambda i: F.aggregate(F.slice(powers, i * FM_GROUP + 1, FM_GROUP), F.lit(0.0), lambda a, x: a + x) / FM_GROUP)
    ordered = F.sort_array(groups)
    n = F.size(ordered)
    middle = (F.element_at(ordered, F.floor((n + 1) / 2).cast("int")) + F.element_at(ordered, F.floor(n / 2).cast("int") + 1)) / 2
    return F.bround(middle, 0).cast("bigint")


def fm_distinct(rows: DataFrame, keys: list, value: str, seed: int = 23) -> DataFrame:
    """(keys, estimate): only greatest values are kept a group, so it works on streams too.

    Null and empty strings don't count."""
    some = numbered(rows, value, FM_MODULUS).where("__x is not null")
    each = [F.max(c).alias(f"__r{i}") for i, c in enumerate(fm_levels(F.col("__x"), seed=seed))]
    grouped = some.groupBy(*keys).agg(*each)
    return grouped.withColumn("estimate", fm_estimate(F.array(*[f"__r{i}" for i in range(len(each))]))).drop(*[f"__r{i}" for i in range(len(each))])


def line_clusters(values: list[float], k: int, rounds: int = 100) -> list[list[float]]:
    """K-Means of a few numbers, starting farthest-first from the first; for parameters and reports, not rows."""
    centres = values[:1]
    while centres and len(centres) < min(k, len(set(values))):
        centres.append(max(values, key=lambda v: min(abs(v - c) for c in centres)))
    groups: list[list[float]] = []
    for _ in range(rounds):
        groups = [[] for _ in centres]
        for v in values:
            groups[min(range(len(centres)), key=lambda i: (abs(v - centres[i]), i))].append(v)
        new = [sum(g) / len(g) if g else c for g, c in zip(groups, centres, strict=True)]
        if new == centres:
            break
        centres = new
    return [g for g in groups if g]


def fm_clustered(levels: list[int], k: int = 10, *, powers: bool = False) -> int:
    """The estimate from greatest trailing zeros by clusters of them, or of their powers of two: the median of the
    clusters' means, ties to even; 0 of nothing."""
    means = sorted(sum(g) / len(g) for g in line_clusters([2.0**r if powers else float(r) for r in levels], k))
    if not means:
        return 0
    middle = (means[(len(means) - 1) // 2] + means[len(means) // 2]) / 2
    return round(middle if powers else 2.0**middle)


def reservoir(rows: DataFrame, size: int, key: str, seed: int = 3) -> DataFrame:
    """A uniform sample of `size` rows: those of the least seeded digest of their key, so any order of rows gives the same."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(size)


def fm_by_clusters(rows: DataFrame, key: str, value: str, k: int = 10, seed: int = 23) -> DataFrame:
    """(key, estimate): as fm_distinct, but by clusters of the exponents; see fm_clustered."""
    some = numbered(rows, value, FM_MODULUS).where("__x is not null")
    each = [F.max(c).alias(f"__r{i}") for i, c in enumerate(fm_levels(F.col("__x"), seed=seed))]
    grouped = some.groupBy(key).agg(*each).select(key, F.array(*[f"__r{i}" for i in range(len(each))]).alias("levels"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):  # one row a group, so few
        for b in batches:
            yield pd.DataFrame({key: b[key], "estimate": [fm_clustered([int(x) for x in v], k) for v in b["levels"]]})

    return grouped.mapInPandas(run, f"`{key}` {kind}, estimate bigint")
