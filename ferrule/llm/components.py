"""Connected components of a link table, by repeated joins.

Every round alternates two steps on the links (u, v): "large star" ties each
node's larger neighbours to its smallest neighbour, "small star" ties its
smaller neighbours and itself to the smallest.  Both keep what is connected
connected and need no more links than there are nodes; when nothing changes,
every link points at the smallest id of its component (Kiveris et al. 2014,
"Connected components in MapReduce and beyond").  Nothing is sent to the driver
but two numbers a round, and each step ends in a written table, so that no plan holds
two.  A node with very many links isn't one task's; see split_join().  Up to LOCAL
links, whatever they were found in, are one task's: rounds of joins over so few cost
the driver more memory for their plans than the links take.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import Forest, drop, materialise, split_join

MOST_ROUNDS = 60
#: Links that one task joins, at 16 bytes a link.
LOCAL = 1 << 18


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ([], [])))
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        forest = Forest(len(nodes))
        for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
            forest.join(x, y)
        roots = np.array([forest.find(x) for x in range(len(nodes))], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[roots], pa.int64())], names=["node", "component"])

    return edges.repartition(1).mapInArrow(run, "node bigint, component bigint")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return split_join(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    kept = split_join(down, low, ["u"], "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return kept.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link to another node; component is the smallest id reached.

    Nodes are long integers.  Links may be repeated, in either direction, or tie a node to itself; a null end ties nothing.
    """
    spark = edges.sparkSession
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    kept: list[str] = []
    now = materialise(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), keep=kept)
    before = None
    for _ in range(MOST_ROUNDS):
        # as many links and the same sums of both ends twice running: nothing moves any more
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        if before is None and state[0] <= LOCAL:
            out = materialise(_in_one_task(now))
            drop(spark, kept)
            return out
        before = state
        old = list(kept)
        kept.clear()
        now = materialise(_small(materialise(_large(now), keep=old)), keep=kept)
        drop(spark, old)
    else:
        raise RuntimeError(f"no fixed point in {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
