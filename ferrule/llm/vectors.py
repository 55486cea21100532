"""Embedding near-dedup by counting collisions of one-dimensional projections.

Unit vectors are projected on many random directions.  On one direction, two
vectors collide if the second lies in the window of half-width w around the
first; w is such that vectors at the threshold collide with chance HIT.  Among m
directions they then collide Binomial(m, HIT) times, and a pair is verified, by
its cosine in double precision, if its count reaches the MISS quantile of that.

So that windows needn't be held against all rows, directions are also taken in
tables of K: a vector's cell in a table is on which side of the middle it lies
on each of the table's directions (the coarsest sorting by K projections at
once).  Collisions are counted within cells.  K follows the number of vectors,
so that a cell has about CELL of them, and the number of tables follows K, so
that vectors at the threshold share a cell with a chance of 1 - MISS.  Vectors
with a greater cosine have a greater chance.  Windows, counts and tables come
from these formulas, none from the data.

A cell with more than BLOCK vectors is dealt out to pairs of blocks, so none is
cut short.  A pair that shares cells of several tables is counted in the first
of them only.  Tasks return, per vector, how many it links with, and a forest of
links, not pairs.  Equal vectors are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import Forest, block_pairs, materialise, split_join
from ferrule.llm.components import components

#: Vectors wanted in a cell, and at most held against as many others at a time.
CELL, BLOCK = 64, 512
#: Directions on which collisions are counted; chance of a collision at the threshold; chance to miss there, of either step.
DIRECTIONS, HIT, MISS = 48, 0.9, 0.01
SEED = 4242


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def least_count(m: int, hit: float, miss: float) -> int:
    """The greatest c with P(Binomial(m, hit) < c) <= miss."""
    below, c = 0.0, 0
    while True:
        below += math.comb(m, c) * hit**c * (1 - hit) ** (m - c)
        if below > miss:
            return c
        c += 1


def plan(n: int, threshold: float) -> tuple[int, int]:
    """Directions a table, and tables, for n vectors."""
    k = max(1, math.ceil(math.log2(max(2, n / CELL))))
    same = (1 - math.acos(threshold) / math.pi) ** k
    return min(k, 60), math.ceil(math.log(MISS) / math.log(1 - same)) if same < 1 else 1


class Space:
    """The directions for vectors of one width."""

    def __init__(self, width: int, k: int, tables: int, threshold: float):
        rng = np.random.Generator(np.random.PCG64([SEED, width]))
        self.k, self.tables = k, tables
        self.windows = rng.standard_normal((width, DIRECTIONS))
        self.sides = rng.standard_normal((width, k * tables))
        self.half = math.sqrt(2 - 2 * threshold) * _normal_quantile((1 + HIT) / 2)
        self.least = least_count(DIRECTIONS, HIT, MISS)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table."""
        side = (unit @ self.sides >= 0).reshape(len(unit), self.tables, self.k)
        return side @ (np.int64(1) << np.arange(self.k, dtype=np.int64))

    def collisions(self, unit: np.ndarray) -> np.ndarray:
        """How often each vector lies in each other one's window: sort each projection, mark where windows begin and end."""
        n = len(unit)
        total = np.zeros((n, n), np.int8)
        spots = unit @ self.windows
        rows = np.arange(n)
        for d in range(DIRECTIONS):
            spot = spots[:, d]
            order = np.argsort(spot, kind="stable")
            line = spot[order]
            marks = np.zeros((n, n + 1), np.int8)
            marks[rows, np.searchsorted(line, spot - self.half)] += 1
            marks[rows, np.searchsorted(line, spot + self.half, "right")] -= 1
            rank = np.empty(n, np.int64)
            rank[order] = rows
            total += np.cumsum(marks[:, :n], axis=1, dtype=np.int8)[:, rank]
        return total


def usable(column) -> F.Column:
    """Neither null nor empty nor zero, and every component finite."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.exists(column, lambda x: x != 0)


def _cells(classes: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    def run(batches):
        spaces: dict[int, Space] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                vectors = part.column(1).to_pylist()
                rep, table, width, cell = [], [], [], []
                for w in {len(v) for v in vectors}:
                    at = np.array([i for i, v in enumerate(vectors) if len(v) == w])
                    space = spaces.setdefault(w, Space(w, k, tables, threshold))
                    got = space.cells(unit_rows([vectors[i] for i in at]))
                    ids = part.column(0).to_numpy(zero_copy_only=False)[at]
                    rep.append(np.repeat(ids, tables))
                    table.append(np.tile(np.arange(tables, dtype=np.int32), len(at)))
                    width.append(np.full(len(at) * tables, w, np.int32))
                    cell.append(got.ravel())
                cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rep, table, width, cell)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["rep", "t", "width", "cell"])

    return classes.select("rep", "v").mapInArrow(run, "rep bigint, t int, width int, cell bigint")


def unit_rows(vectors) -> np.ndarray:
    """Vectors of unit length, in double precision; scaled first, so that large components don't overflow."""
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(unit: np.ndarray, side: np.ndarray, table: int, space: Space, threshold: float) -> np.ndarray:
    """Which pairs link: across the two sides, or, with one side only, all; those that meet in an earlier table aside."""
    cells = space.cells(unit)
    first = np.ones((len(unit), len(unit)), bool)
    for t in range(table):
        first &= cells[:, None, t] != cells[None, :, t]
    if side.min() != side.max():
        first &= side[:, None] != side[None, :]
    np.fill_diagonal(first, False)
    if not first.any():
        return first
    found = first & (space.collisions(unit) >= space.least)
    i, j = np.nonzero(np.triu(found))
    good = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 15):
        b = slice(a, a + (1 << 15))
        good[b] = np.einsum("ij,ij->i", unit[i[b]], unit[j[b]]) >= threshold
    out = np.zeros_like(first)
    out[i[good], j[good]] = True
    return out | out.T


def _links(dealt: DataFrame, k: int, tables: int, threshold: float) -> DataFrame:
    """(rep, links, other): what each pair of blocks adds to a vector's number of links, and a forest's links (links 0)."""

    def run(batches):
        spaces: dict[int, Space] = {}
        key, ids, counts, side, vectors = None, [], [], [], []

        def done():
            rep, links, other = [], [], []
            if len(ids) > 1:
                space = spaces.setdefault(key[1], Space(key[1], k, tables, threshold))
                linked = compare(unit_rows(vectors), np.array(side), key[0], space, threshold)
                total = linked @ np.array(counts, np.int64)
                some = np.flatnonzero(total)
                forest = Forest(len(ids))
                rep, links, other = [ids[i] for i in some], total[some].tolist(), [None] * len(some)
                for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked))), strict=True):
                    if forest.join(i, j):
                        rep.append(ids[i])
                        links.append(0)
                        other.append(ids[j])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (rep, links, other)], names=["rep", "links", "other"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for t, w, cell, p, q, mine, rep, count, v in zip(*cols, strict=True):
                if (t, w, cell, p, q) != key:
                    yield done()
                    key, ids, counts, side, vectors = (t, w, cell, p, q), [], [], [], []
                ids.append(rep)
                counts.append(count)
                side.append(mine)
                vectors.append(v)
        yield done()

    return dealt.mapInArrow(run, "rep bigint, links bigint, other bigint")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, scratch: list[str] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per vector.

    Vectors link when their cosine is at least `threshold` (0 to 1); vectors that
    are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do vectors of different width.  n_links counts other vectors
    linked directly, equal ones included; component_id is the smallest id that
    links reach.  Ids are whole numbers.  A row whose id is null, or no whole
    number, is a vector like any other; its component_id is null where its class
    has no other id, and it is kept then.  Rows that share an id are vectors of
    their own.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = [] if scratch is None else scratch
    # single precision stays as it is until it is compared, so that half as much is shuffled
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).try_cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.withColumn("v", F.when(usable(F.col("v")), F.transform("v", lambda x: x + F.lit(0.0).cast(kind))))
    classes = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialise(classes.withColumn("rep", F.monotonically_increasing_id()), keep=scratch)
    k, tables = plan(classes.count(), threshold)
    cells = _cells(classes, k, tables, threshold)
    dealt = block_pairs(cells, ["t", "width", "cell"], "rep", BLOCK).join(classes, "rep")
    keys = ["t", "width", "cell", "p", "q"]
    parts = 2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.select(*keys, "mine", "rep", "copies", "v").repartition(parts, *keys).sortWithinPartitions(*keys)
    found = materialise(_links(dealt, k, tables, threshold), keep=scratch)
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.where("other is not null"), "rep", "other").withColumnRenamed("node", "rep")
    per_class = classes.join(counts, "rep", "left").join(reached, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    least = per_class.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("of_root"))
    per_class = split_join(per_class.drop("component"), least, ["root"], "of_root")
    per_class = per_class.select("v", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = split_join(rows.where("v is not null"), per_class, ["v"], "copies").select("id", F.col("n_links").cast("bigint"), "component_id")
    out = linked.unionByName(rows.where("v is null").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
