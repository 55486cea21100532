"""The graph of customers who ordered several parts in common, and clusterings of the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import cluster, graph, metrics
from ferrule.operators.lineage import cut
from ferrule.sources.tables import table

#: Parts that customers have in common to be neighbours; embeddings are clustered into so many.
LEAST, K = 7, 10


def _edges(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).select("o_custkey", "l_partkey").distinct()
    return graph.cooccurrence(rows, "o_custkey", "l_partkey", LEAST)


def _graph(spark, d):
    return cut(_edges(spark, d).select("u", "v"))


def cooccurrence_edges(spark, d):
    return _edges(spark, d)


def graph_degree(spark, d):
    return graph.degrees(_graph(spark, d))


def graph_isolated(spark, d):
    """Customers without a neighbour."""
    return graph.isolated(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), _graph(spark, d))


def components(spark, d):
    return graph.components(_graph(spark, d))


def modularity(spark, d):
    """Of the components as communities."""
    edges = _graph(spark, d)
    return graph.modularity(graph.components(edges), edges).select(F.round("q", 9).alias("q"))


def community_list(spark, d):
    found = graph.communities(graph.components(_graph(spark, d)).withColumnRenamed("component", "label"))
    return found.select("size", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def edge_betweenness(spark, d):
    return graph.edge_betweenness(_graph(spark, d)).select("u", "v", F.round("betweenness", 6).alias("betweenness"))


def girvan_newman(spark, d):
    return graph.girvan_newman(_graph(spark, d))


def label_propagation(spark, d):
    return graph.label_propagation(_graph(spark, d))


def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("attrs"), "label")


def _means(points):
    """A centroid a label: at most as many rows as there are labels."""
    stats = cluster.sum_statistics(points.withColumnRenamed("label", "tag")).orderBy("tag", "pos").collect()
    out: dict[int, tuple[list, list]] = {}
    for r in stats:
        mean = r.total / r.n
        a, b = out.setdefault(r.tag, ([], []))
        a.append(mean)
        b.append(max(0.0, r.squares / r.n - mean * mean) ** 0.5)
    return out


def kmeans_assign_once(spark, d):
    """The nearest label mean of each embedding."""
    points = _points(spark, d)
    return cluster.assign(points.select("idx", "attrs"), {t: m for t, (m, _) in _means(points).items()}).select("idx", "tag", F.round("distance", 6).alias("distance"))


def cluster_sumstats(spark, d):
    found = cluster.sum_statistics(_points(spark, d).withColumnRenamed("label", "tag"))
    return found.select("tag", "pos", "n", F.round("total", 6).alias("total"), F.round("squares", 6).alias("squares"))


def mahalanobis_nearest(spark, d):
    """The label whose mean is nearest by its own deviations."""
    points = _points(spark, d)
    known = [(t, m, s) for t, (m, s) in _means(points).items()]
    row = F.broadcast(spark.createDataFrame([(known,)], "known array<struct<tag: bigint, mean: array<double>, deviation: array<double>>>"))
    near = F.array_min(F.transform("known", lambda c: F.struct(cluster.mahalanobis(F.col("attrs"), c["mean"], c["deviation"]).alias("distance"), c["tag"].alias("tag"))))
    return points.crossJoin(row).withColumn("near", near).select("idx", "near.tag", F.round("near.distance", 6).alias("distance"))


def kmeans(spark, d):
    tagged, _ = cluster.kmeans(_points(spark, d).select("idx", "attrs"), K)
    return tagged.select("idx", "tag")


def _bfr(spark, d):
    points = _points(spark, d).select("idx", "attrs")
    most = points.agg(F.max("idx").alias("m")).first().m or 0
    step = most // 5 + 1
    return cluster.bfr([points.where(F.floor(F.col("idx") / step) == i) for i in range(5)], K)


def bfr(spark, d):
    """Labels of the embeddings, taken in five chunks."""
    return _bfr(spark, d)[0]


def bfr_round_stats(spark, d):
    """Sets and their points after each chunk; points add up to those taken in so far."""
    return _bfr(spark, d)[1]


def nmi(spark, d):
    """How far parts' brands tell their types."""
    return metrics.nmi(table(spark, d, "part"), "p_brand", "p_type").select(F.round("nmi", 9).alias("nmi"))


QUERIES = {f.__name__: f for f in (cooccurrence_edges, graph_degree, graph_isolated, components, modularity, community_list, edge_betweenness, girvan_newman, label_propagation, kmeans_assign_once, cluster_sumstats, mahalanobis_nearest, kmeans, bfr, bfr_round_stats, nmi)}

_E = "c AS (SELECT DISTINCT o_custkey AS k, l_partkey AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT x.k AS u, y.k AS v, count(*) AS n FROM c x JOIN c y ON x.i = y.i AND x.k < y.k GROUP BY 1, 2 HAVING count(*) >= 7), b AS (SELECT u AS s, v AS t FROM e UNION ALL SELECT v, u FROM e)"
_REACH = f"{_E}, reach(id, far) AS (SELECT DISTINCT s, s FROM b UNION SELECT id, t FROM reach JOIN b ON far = s), comp AS (SELECT id, min(far) AS component FROM reach GROUP BY 1)"
_LONG = "x AS (SELECT vec_id AS idx, label, generate_subscripts(embedding, 1) - 1 AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT label AS tag, pos, count(*) AS n, sum(x) AS total, sum(x * x) AS squares FROM x GROUP BY 1, 2)"
SQL = {
    "cooccurrence_edges": f"WITH {_E} SELECT u, v, n FROM e",
    "graph_degree": f"WITH {_E} SELECT s AS id, count(*) AS degree FROM b GROUP BY 1",
    "graph_isolated": f"WITH {_E} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT s FROM b)",
    "components": f"WITH RECURSIVE {_REACH} SELECT id, component FROM comp",
    "modularity": f"WITH RECURSIVE {_REACH}, m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e), i AS (SELECT component, count(*) AS e FROM e JOIN comp ON id = u GROUP BY 1), g AS (SELECT component, count(*) AS d FROM b JOIN comp ON id = s GROUP BY 1) SELECT round(sum(i.e / m - pow(g.d / (2 * m), 2)), 9) AS q FROM i JOIN g USING (component), m",
    "label_propagation": f"WITH {_E}, l0 AS (SELECT DISTINCT s AS id, s AS label FROM b), " + ", ".join(f"v{i} AS (SELECT t AS id, label, count(*) AS n FROM b JOIN l{i - 1} ON id = s GROUP BY 1, 2), l{i} AS (SELECT id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM v{i}) WHERE r = 1)" for i in range(1, 6)) + " SELECT id, label FROM l5",
    "edge_betweenness": f"""WITH RECURSIVE {_E}, far(src, id, depth) USING KEY (src, id) AS (SELECT DISTINCT s, s, 0 FROM b
            UNION SELECT f.src, b.t, min(f.depth) + 1 FROM far f JOIN b ON b.s = f.id LEFT JOIN recurring.far o ON o.src = f.src AND o.id = b.t WHERE o.id IS NULL GROUP BY 1, 2),
        paths(src, id, depth, n) AS (SELECT src, id, depth, CAST(1 AS DOUBLE) FROM far WHERE depth = 0 UNION ALL SELECT p.src, f.id, f.depth, sum(p.n) FROM paths p JOIN b ON b.s = p.id JOIN far f ON f.src = p.src AND f.id = b.t AND f.depth = p.depth + 1 GROUP BY 1, 2, 3),
        deepest AS (SELECT max(depth) AS d FROM far),
        down AS (SELECT f.src, p.id AS up, f.id AS low, f.depth, p.n / f.n AS part FROM paths f JOIN b ON b.t = f.id JOIN paths p ON p.src = f.src AND p.id = b.s AND p.depth = f.depth - 1),
        share(src, up, low, depth, part) AS (SELECT src, up, low, depth, part FROM down
            UNION ALL SELECT d.src, d.up, d.low, d.depth, d.part * s.part FROM share s JOIN down d ON d.src = s.src AND d.low = s.up)
        SELECT least(up, low) AS u, greatest(up, low) AS v, round(sum(part) / 2, 6) AS betweenness FROM share GROUP BY 1, 2""",
    "community_list": f"WITH RECURSIVE {_REACH} SELECT CAST(count(*) AS INT) AS size, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM comp GROUP BY component",
    "kmeans_assign_once": f"WITH {_LONG}, dist AS (SELECT idx, tag, sum(pow(x - total / n, 2)) AS d FROM x JOIN m ON x.pos = m.pos GROUP BY 1, 2) SELECT idx, CAST(arg_min(tag, d) AS BIGINT) AS tag, round(sqrt(min(d)), 6) AS distance FROM dist GROUP BY 1",
    "cluster_sumstats": f"WITH {_LONG} SELECT tag, CAST(pos AS INT) AS pos, n, round(total, 6) AS total, round(squares, 6) AS squares FROM m",
    "mahalanobis_nearest": f"WITH {_LONG}, s AS (SELECT tag, pos, total / n AS mean, sqrt(greatest(0.0, squares / n - pow(total / n, 2))) AS sd FROM m), dist AS (SELECT idx, tag, sqrt(sum(pow((x - mean) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 2))) AS d FROM x JOIN s ON x.pos = s.pos GROUP BY 1, 2) SELECT idx, CAST(arg_min(tag, d) AS BIGINT) AS tag, round(min(d), 6) AS distance FROM dist GROUP BY 1",
    "nmi": "WITH j AS (SELECT p_brand AS a, p_type AS b, CAST(count(*) AS DOUBLE) AS n FROM part GROUP BY 1, 2), t AS (SELECT sum(n) AS t FROM j), x AS (SELECT a, sum(n) AS n FROM j GROUP BY 1), y AS (SELECT b, sum(n) AS n FROM j GROUP BY 1), i AS (SELECT sum(j.n / t * ln(j.n * t / (x.n * y.n))) AS i FROM j JOIN x ON x.a = j.a JOIN y ON y.b = j.b, t), hx AS (SELECT -sum(n / t * ln(n / t)) AS h FROM x, t), hy AS (SELECT -sum(n / t * ln(n / t)) AS h FROM y, t) SELECT round(i / sqrt(hx.h * hy.h), 9) AS nmi FROM i, hx, hy",
}
