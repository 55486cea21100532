"""Graphs of co-occurrence: degrees, components, label propagation, betweenness, communities.

Edges are undirected, in a table (u, v) with u < v.  Loops are driver loops over
tables, with a checkpoint a round.  Edge betweenness has two forms: a graph of
at most LOCAL_EDGES edges goes to the tasks as a whole, one task taking some of
its vertices as sources; a larger one is searched by joins, level by level.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import pairs
from ferrule.operators.lineage import cut

#: Edges up to which a graph fits into every task.
LOCAL_EDGES = 50_000
#: How much two betweenness values, or modularities, may differ and count as equal.
SAME, BETTER = 1e-9, 1e-11


def cooccurrence(rows: DataFrame, key: str, item: str, least: int) -> DataFrame:
    """(u, v, n): keys with at least `least` common items.  Keys without such a partner have no vertex."""
    return pairs.pairs(rows, key, item, least=least).select(F.col("a").alias("u"), F.col("b").alias("v"), "n")


def canonical(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) with u < v; loops and null ends dropped."""
    return edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct()


def mirrored(edges: DataFrame) -> DataFrame:
    """Edges in both directions, as (src, dst)."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(edges.select("v", "u"))


def degrees(edges: DataFrame) -> DataFrame:
    return mirrored(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return canonical(edges.select("u", "v").union(more.select("u", "v")))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(canonical(gone), ["u", "v"], "left_anti")


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that no edge touches."""
    return vertices.select("id").distinct().join(degrees(edges), "id", "left_anti")


def components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id that edges reach.  Vertices without an edge are their own component.

    Large-star and small-star rounds; logarithmically many in the number of vertices."""
    both = mirrored(edges)
    ids = both.select(F.col("src").alias("id")).distinct()
    now = cut(canonical(edges).select(F.col("v").alias("u"), F.col("u").alias("v")))
    state = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state or not new[0]:
            break
        state = new
        two = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = two.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    reached = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    if vertices is not None:
        ids = ids.union(vertices.select("id")).distinct()
    return ids.join(reached, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): each vertex takes the label that most of its neighbours had the round before, the smallest of equals."""
    both = cut(mirrored(edges))
    labels = both.select(F.col("src").alias("id"), F.col("src").alias("label")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy("dst", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("dst").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b"))
        labels = cut(best.select(F.col("dst").alias("id"), F.col("b.label").alias("label")))
    return labels


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(size, members) a label, in the order of size and first member."""
    groups = labels.groupBy(label).agg(F.sort_array(F.collect_list("id")).alias("members"))
    return groups.select(F.size("members").alias("size"), "members").orderBy("size", F.col("members")[0])


def modularity(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(q) of a partition (id, component): over components, inner edges by all, less the squared share of degrees."""
    m = edges.agg(F.count("*").alias("m"))
    of = groups.select(F.col("id"), "component")
    inner = edges.join(of.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u").join(of.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v").where("cu = cv").groupBy(F.col("cu").alias("component")).agg(F.count("*").alias("e"))
    degree = degrees(edges).join(of, "id").groupBy("component").agg(F.sum("degree").alias("d"))
    terms = degree.join(inner, "component", "left").fillna(0, ["e"]).crossJoin(F.broadcast(m))
    return terms.agg(F.sum(F.col("e") / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("q"))


def _adjacency(edges: list[tuple]) -> dict:
    near: dict = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return near


def _credits(near: dict, source) -> dict:
    """What each edge carries of the shortest paths from one source to all vertices."""
    depth, paths, order, queue = {source: 0}, {source: 1.0}, [], deque([source])
    while queue:
        x = queue.popleft()
        order.append(x)
        for y in sorted(near[x]):
            if y not in depth:
                depth[y] = depth[x] + 1
                paths[y] = 0.0
                queue.append(y)
            if depth[y] == depth[x] + 1:
                paths[y] += paths[x]
    flow = dict.fromkeys(order, 1.0)
    out = {}
    for y in reversed(order):
        for x in near[y]:
            if depth[x] == depth[y] - 1:
                share = flow[y] * paths[x] / paths[y]
                flow[x] += share
                out[(x, y) if x < y else (y, x)] = share
    return out


def _betweenness(near: dict) -> dict:
    total: dict = {}
    for s in sorted(near):
        for e, c in _credits(near, s).items():
            total[e] = total.get(e, 0.0) + c / 2
    return total


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(u, v, betweenness): shortest paths through each edge, split evenly among those of equal length."""
    few = edges.select("u", "v").limit(LOCAL_EDGES + 1).collect()
    if len(few) > LOCAL_EDGES:
        return _betweenness_by_joins(edges)
    kind = edges.schema["u"].dataType.simpleString()
    near = edges.sparkSession.sparkContext.broadcast(_adjacency([(r.u, r.v) for r in few]))
    sources = mirrored(edges).select("src").distinct()

    def run(batches):
        total: dict = {}
        for batch in batches:
            for s in batch["src"]:
                for e, c in _credits(near.value, s).items():
                    total[e] = total.get(e, 0.0) + c / 2
        yield pd.DataFrame([(u, v, c) for (u, v), c in total.items()], columns=["u", "v", "c"])

    parts = sources.repartition("src").mapInPandas(run, f"u {kind}, v {kind}, c double")
    return parts.groupBy("u", "v").agg(F.sum("c").alias("betweenness"))


def _betweenness_by_joins(edges: DataFrame) -> DataFrame:
    """The same by joins: all sources at once, one level of depth a round, then back from the deepest."""
    both = cut(mirrored(edges))
    found = cut(both.select("src").distinct().select("src", F.col("src").alias("at"), F.lit(0).alias("depth"), F.lit(1.0).alias("paths")))
    level, depth = found, 0
    steps = []
    near = both.select(F.col("src").alias("at"), F.col("dst").alias("to"))
    while True:
        reach = level.join(near, "at").join(found.select("src", F.col("at").alias("to")), ["src", "to"], "left_anti")
        step = cut(reach.select("src", F.col("at").alias("parent"), "to", "paths"))
        if not step.limit(1).count():
            break
        depth += 1
        steps.append(step)
        level = cut(step.groupBy("src", F.col("to").alias("at")).agg(F.lit(depth).alias("depth"), F.sum("paths").alias("paths")))
        found = cut(found.unionByName(level))
    flow, out = None, None
    for step in reversed(steps):
        total = step.select("src", F.col("to").alias("at")).distinct().join(found, ["src", "at"])
        total = total.join(flow, ["src", "at"], "left") if flow is not None else total.withColumn("f", F.lit(0.0))
        total = total.select("src", F.col("at").alias("to"), F.col("paths").alias("all"), (1 + F.coalesce("f", F.lit(0.0))).alias("has"))
        share = cut(step.join(total, ["src", "to"]).select("src", "parent", "to", (F.col("has") * F.col("paths") / F.col("all")).alias("c")))
        flow = cut(share.groupBy("src", F.col("parent").alias("at")).agg(F.sum("c").alias("f")))
        part = share.groupBy(F.least("parent", "to").alias("u"), F.greatest("parent", "to").alias("v")).agg((F.sum("c") / 2).alias("c"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("u", "v").agg(F.sum("c").alias("betweenness"))


def remove_most_between(edges: DataFrame) -> DataFrame:
    """Edges without all that share the greatest betweenness."""
    values = cut(edge_betweenness(edges))
    top = values.agg(F.max("betweenness").alias("top"))
    return values.crossJoin(F.broadcast(top)).where(F.col("betweenness") < F.col("top") - SAME).select("u", "v")


def girvan_newman(edges: DataFrame) -> DataFrame:
    """(id, component): communities of the first cut whose modularity, by the uncut graph, no earlier or later one beats.

    All edges that share the greatest betweenness go at once, until none is left."""
    few = edges.select("u", "v").limit(LOCAL_EDGES + 1).collect()
    if len(few) <= LOCAL_EDGES:
        return _girvan_newman_local(edges, [(r.u, r.v) for r in few])
    now, best, answer = cut(edges.select("u", "v")), None, None
    vertices = mirrored(edges).select(F.col("src").alias("id")).distinct()
    while True:
        groups = cut(components(now, vertices))
        q = modularity(groups, edges).first().q
        if best is None or q > best + BETTER:
            best, answer = q, groups
        if not now.limit(1).count():
            return answer
        now = cut(remove_most_between(now))


def _girvan_newman_local(edges: DataFrame, all_edges: list[tuple]) -> DataFrame:
    """The loop over a graph that fits into one task, in one task."""
    kind = edges.schema["u"].dataType.simpleString()

    def parts(near: dict) -> dict:
        out: dict = {}
        for s in sorted(near):
            if s not in out:
                todo = [s]
                while todo:
                    x = todo.pop()
                    if x not in out:
                        out[x] = s
                        todo += near[x]
        return out

    def run(batches):
        for _ in batches:
            pass
        near = _adjacency(all_edges)
        degree, m = {x: len(y) for x, y in near.items()}, len(all_edges)
        best, answer, values = None, {}, {}
        dirty = set(near)  # vertices whose component was cut since betweenness was last computed
        while near:
            groups = parts(near)
            inner: dict = {}
            load: dict = {}
            for x, d in degree.items():
                load[groups[x]] = load.get(groups[x], 0) + d
            for u, v in all_edges:
                if groups[u] == groups[v]:
                    inner[groups[u]] = inner.get(groups[u], 0) + 1
            q = sum(inner.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in load.items())
            if best is None or q > best + BETTER:
                best, answer = q, groups
            values = {e: c for e, c in values.items() if e[0] not in dirty}
            values.update(_betweenness({x: near[x] for x in dirty}))
            if not values:
                break
            top = max(values.values())
            gone = [e for e, c in values.items() if c >= top - SAME]
            for u, v in gone:
                near[u].discard(v)
                near[v].discard(u)
                del values[(u, v)]
            touched = {groups[u] for u, _ in gone}
            dirty = {x for x in near if groups[x] in touched}
        yield pd.DataFrame(sorted(answer.items()), columns=["id", "component"])

    return edges.sparkSession.range(1).coalesce(1).mapInPandas(run, f"id {kind}, component {kind}")
