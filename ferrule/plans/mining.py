"""Itemsets, similar pairs, text profiles and sketches over the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import itemsets as I  # noqa: E741
from ferrule.operators import lsh, pairs, profiles, sketch
from ferrule.operators.relational import top_levels, values_by_count
from ferrule.sources.tables import ratings, table
from ferrule.streaming import windows

#: Support by which brands go together, sized to the table.
SUPPORT_SHARE = 70 / 15_000


def _brand_baskets(spark, d):
    brands = table(spark, d, "part").select("p_partkey", "p_brand")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return I.baskets(li.join(brands, li.l_partkey == brands.p_partkey), "l_orderkey", "p_brand")


def _support(spark, d):
    return max(2, int(table(spark, d, "orders").count() * SUPPORT_SHARE))


def _sets(spark, d, size):
    found = I.of_size(_brand_baskets(spark, d), _support(spark, d), size)
    return found.select(F.array_join("items", ",").alias("items"), "support")


def itemsets_k1(spark, d):
    return _sets(spark, d, 1)


def itemsets_k2(spark, d):
    return _sets(spark, d, 2)


def itemsets_k3(spark, d):
    return _sets(spark, d, 3)


def son_itemsets(spark, d):
    """Frequent brand sets of any size by two phases."""
    found = I.by_partitions(_brand_baskets(spark, d), _support(spark, d))
    return found.select(F.array_join("items", ",").alias("items"), "support")


def itemset_report(spark, d):
    """Frequent brand sets as report lines."""
    return I.report_lines(I.frequent(_brand_baskets(spark, d), _support(spark, d)))


def _supplier_baskets(spark, d):
    return I.baskets(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", 2)


def pcy_bucket_counts(spark, d):
    return I.pair_buckets(_supplier_baskets(spark, d))


def pcy_pairs(spark, d):
    """Frequent supplier pairs of baskets with more than two, by hashed pair counts."""
    found = I.hashed_pairs(_supplier_baskets(spark, d), 5)
    return found.select(F.col("items")[0].alias("x"), F.col("items")[1].alias("y"), "support")


def pcy_itemsets(spark, d):
    """Frequent supplier sets of any size, pairs by hashed pair counts."""
    found = I.frequent_by_buckets(_supplier_baskets(spark, d), 3)
    return found.select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), "support")


def jaccard_pairs(spark, d):
    rows = ratings(spark, d).select("user", "item")
    return pairs.jaccard(rows, "item", "user", 0.05).select("a", "b", F.round("sim", 6).alias("sim"))


def set_cosine_pairs(spark, d):
    rows = ratings(spark, d).select("user", "item")
    return pairs.set_cosine(rows, "item", "user", 0.1).select("a", "b", F.round("sim", 6).alias("sim"))


def cosine_pairs(spark, d):
    return pairs.cosine(ratings(spark, d), "item", "user", "stars", 5, 0.8).select("a", "b", F.round("sim", 6).alias("sim"))


def minhash_similar(spark, d):
    """Item pairs that share one of 48 buckets of one hash each and whose coefficient is 0.05 or more: most of jaccard_pairs."""
    return lsh.similar(ratings(spark, d).select("user", "item"), "item", "user", n_hashes=48, numbers=True).select("a", "b", F.round("sim", 6).alias("sim"))


def _profiles(spark, d):
    docs = table(spark, d, "documents").select("source", "text")
    counts = profiles.drop_rare_words(profiles.word_counts(docs, "source", "text"), 1e-5)
    return profiles.top_words(profiles.tfidf(counts, docs.select("source").distinct().count()), 200)


def tfidf_topn(spark, d):
    return _profiles(spark, d).select("doc", "word", F.round("weight", 6).alias("weight"), "rank")


def profile_cosine(spark, d):
    """Languages as users of the sources that they occur in, held against all sources."""
    found = _profiles(spark, d)
    docs = table(spark, d, "documents")
    visits = docs.select("lang", "source").distinct()
    users = profiles.user_profiles(visits, found, "lang", "source")
    wanted = docs.select(F.col("lang").alias("user"), F.col("source").alias("doc")).distinct()
    return profiles.score(wanted, users, found).select("user", "doc", F.round("sim", 6).alias("sim"))


def _names(spark, d, rest):
    return table(spark, d, "part").where(F.col("p_partkey") % 2 == rest).select("p_partkey", "p_name")


def bloom_bits(spark, d):
    return sketch.bloom_bits(_names(spark, d, 0), "p_name")


def bloom_probe(spark, d):
    """Names of odd parts against a filter of the names of even ones."""
    return sketch.bloom_probe(_names(spark, d, 1), "p_name", sketch.bloom_bits(_names(spark, d, 0), "p_name"))


def bloom_quality(spark, d):
    from ferrule.operators.metrics import filter_quality

    first = table(spark, d, "customer").where("c_custkey % 3 = 0").select("c_name")
    probed = sketch.bloom_probe(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name", sketch.bloom_bits(first, "c_name"))
    out = filter_quality(probed.select((F.col("c_custkey") % 3 == 0).alias("t"), (F.col("seen") == 1).alias("s")), "t", "s")
    return out.select(F.round("fpr", 6).alias("fpr"), F.round("fnr", 6).alias("fnr"))


def fm_daily(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("user"))
    return sketch.fm_distinct(events, ["day"], "user")


def sliding_distinct(spark, d):
    found = windows.exact_sliding_distinct(table(spark, d, "events"), "ts", "user_id", "3 hours", "1 hour")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def fm_sliding(spark, d):
    """Flajolet-Martin counts of distinct users in sliding windows."""
    events = table(spark, d, "events").select("ts", F.col("user_id").cast("string").alias("user"))
    found = windows.sliding_distinct(events, "ts", "user", "3 hours", "1 hour")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "estimate")


def fm_clusters(spark, d):
    """Distinct users a day by clusters of the exponents."""
    events = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.col("user_id").cast("string").alias("user"))
    return sketch.fm_by_clusters(events, "day", "user")


def top_tag_levels(spark, d):
    """Users whose numbers of events are among the three greatest."""
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("tag")).agg(F.count("*").alias("count"))
    best = top_levels(counts, 3)
    return best.select("tag", "count", F.col("level").cast("bigint").alias("level"))


def tags_by_count(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("user_id").alias("tag")).agg(F.count("*").alias("count"))
    return values_by_count(counts, "tag").select("count", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("tags"))


def reservoir_sample(spark, d):
    """A hundred events, uniformly: the sampling operator's limit is its feature."""
    return sketch.reservoir(table(spark, d, "events").select("event_id", "user_id", "event_type"), 100, "event_id")


QUERIES = {f.__name__: f for f in (itemsets_k1, itemsets_k2, itemsets_k3, son_itemsets, itemset_report, pcy_bucket_counts, pcy_pairs, pcy_itemsets, jaccard_pairs, set_cosine_pairs, cosine_pairs, minhash_similar, tfidf_topn, profile_cosine, bloom_bits, bloom_probe, bloom_quality, fm_daily, sliding_distinct, fm_sliding, fm_clusters, top_tag_levels, tags_by_count, reservoir_sample)}

_BASKETS = "b AS (SELECT DISTINCT l_orderkey AS o, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT greatest(2, CAST(floor(count(*) * CAST(70 AS DOUBLE) / 15000) AS BIGINT)) AS s FROM orders)"
#: Frequent sets of any size: each grows by the greater items of the baskets that hold it.
_ALL = "WITH RECURSIVE {b}, g(o, l, items, k) AS (SELECT o, i, CAST(i AS VARCHAR), 1 FROM b UNION ALL SELECT g.o, b.i, g.items || ',' || b.i, k + 1 FROM g JOIN b ON g.o = b.o AND b.i > g.l), f AS (SELECT items, k, count(*) AS support FROM g GROUP BY 1, 2 HAVING count(*) >= {least})"
_ONE = "SELECT i AS items, count(*) AS support FROM b GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)"
_TWO = "SELECT x.i || ',' || y.i AS items, count(*) AS support FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)"
_THREE = "SELECT x.i || ',' || y.i || ',' || z.i AS items, count(*) AS support FROM b x JOIN b y ON x.o = y.o AND x.i < y.i JOIN b z ON y.o = z.o AND y.i < z.i GROUP BY 1 HAVING count(*) >= (SELECT s FROM s)"
_SUPPLIERS = "b AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS i FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 2))"
RATINGS = 'r AS (SELECT o_custkey AS "user", l_partkey AS item, CAST(sum(1 + CAST(l_quantity AS INT) % 5) AS DOUBLE) / count(*) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)'
_PAIRS = 'p AS (SELECT x.item AS a, y.item AS b, count(*) AS n, sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy, sum(x.stars * y.stars) AS sxy FROM r x JOIN r y ON x."user" = y."user" AND x.item < y.item GROUP BY 1, 2), z AS (SELECT item, count(*) AS n FROM r GROUP BY 1)'
_TOKENS = "t AS (SELECT source AS doc, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c0 AS (SELECT doc, word, count(*) AS n FROM t GROUP BY 1, 2), c AS (SELECT * FROM c0 WHERE word IN (SELECT word FROM c0 GROUP BY 1 HAVING sum(n) > (SELECT floor(sum(n) * CAST(1e-5 AS DOUBLE)) FROM c0)))"
_TFIDF = f"{_TOKENS}, w AS (SELECT c.doc, c.word, CAST(n AS DOUBLE) / most * log2(CAST((SELECT count(DISTINCT source) FROM documents) AS DOUBLE) / df) AS weight FROM c JOIN (SELECT doc, max(n) AS most FROM c GROUP BY 1) m ON c.doc = m.doc JOIN (SELECT word, count(*) AS df FROM c GROUP BY 1) f ON c.word = f.word), k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY round(weight, 9) DESC, word) AS rank FROM w), prof AS (SELECT * FROM k WHERE rank <= 200)"


def _number(s: str, modulus: int) -> str:
    """The UTF-8 bytes of a string as a number, in DuckDB."""
    return f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, length(hex({s})) // 2), lambda i: CAST('0x' || substr(hex({s}), 2 * i + 1, 2) AS BIGINT))), lambda acc, v: (acc * 256 + v) % {modulus})"


def _positions(s: str) -> str:
    ab = sketch.hash_parameters(20, 30_000)
    return "[" + ", ".join(f"({_number(s, sketch.NUMBERS)} * {a} + {b}) % 30000" for a, b in ab) + "]"


def _fm_sql(rows: str = "SELECT CAST(ts AS DATE) AS day, user_id FROM events", key: str = "day") -> str:
    each = [f"max(CASE WHEN h{i} = 0 THEN 0 ELSE bit_count((h{i} & -h{i}) - 1) END) AS r{i}" for i in range(sketch.FM_HASHES)]
    hashes = [f"(x * {a} + {b}) % {sketch.FM_MODULUS} AS h{i}" for i, (a, b) in enumerate(sketch.hash_parameters(sketch.FM_HASHES, sketch.FM_MODULUS, 23))]
    groups = [f"(pow(2.0, r{i}) + pow(2.0, r{i + 1}) + pow(2.0, r{i + 2})) / 3" for i in range(0, sketch.FM_HASHES, 3)]
    return f"""
        WITH w AS ({rows}), u AS (SELECT DISTINCT user_id, {_number("CAST(user_id AS VARCHAR)", sketch.FM_MODULUS)} AS x FROM w),
        h AS (SELECT {key}, {", ".join(hashes)} FROM w JOIN u USING (user_id)), r AS (SELECT {key}, {", ".join(each)} FROM h GROUP BY {key}),
        g AS (SELECT {key}, list_sort([{", ".join(groups)}]) AS g FROM r)
        SELECT {key}, CAST(round_even((g[5] + g[6]) / 2, 0) AS BIGINT) AS estimate FROM g"""


_WINDOWS = "SELECT user_id, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 2 HOUR]) AS w FROM events"
SQL = {
    "itemsets_k1": f"WITH {_BASKETS} {_ONE}",
    "itemsets_k2": f"WITH {_BASKETS} {_TWO}",
    "itemsets_k3": f"WITH {_BASKETS} {_THREE}",
    "son_itemsets": _ALL.format(b=_BASKETS, least="(SELECT s FROM s)") + " SELECT items, support FROM f",
    "itemset_report": _ALL.format(b=_BASKETS, least="(SELECT s FROM s)") + """ SELECT CAST(k AS INT) AS size, string_agg('(''' || replace(items, ',', ''', ''') || ''')', ',' ORDER BY string_split(items, ',')) AS line FROM f GROUP BY 1""",
    "pcy_itemsets": _ALL.format(b=_SUPPLIERS, least=3) + " SELECT items, support FROM f",
    "pcy_bucket_counts": f"WITH {_SUPPLIERS} SELECT x.i * y.i % 1000 AS bucket, count(*) AS n FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1",
    "pcy_pairs": f"WITH {_SUPPLIERS} SELECT x.i AS x, y.i AS y, count(*) AS support FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY 1, 2 HAVING count(*) >= 5",
    "jaccard_pairs": f"WITH {RATINGS}, {_PAIRS} SELECT a, b, round(CAST(p.n AS DOUBLE) / (x.n + y.n - p.n), 6) AS sim FROM p JOIN z x ON a = x.item JOIN z y ON b = y.item WHERE CAST(p.n AS DOUBLE) / (x.n + y.n - p.n) >= CAST(0.05 AS DOUBLE)",
    "minhash_similar": f"""WITH {RATINGS}, {lsh.sql('SELECT item AS key, "user" AS x FROM r', 48)}, {_PAIRS} SELECT a, b, round(CAST(p.n AS DOUBLE) / (x.n + y.n - p.n), 6) AS sim FROM p JOIN z x ON a = x.item JOIN z y ON b = y.item SEMI JOIN cand USING (a, b) WHERE CAST(p.n AS DOUBLE) / (x.n + y.n - p.n) >= CAST(0.05 AS DOUBLE)""",
    "set_cosine_pairs": f"WITH {RATINGS}, {_PAIRS} SELECT a, b, round(p.n / sqrt(x.n * y.n), 6) AS sim FROM p JOIN z x ON a = x.item JOIN z y ON b = y.item WHERE p.n / sqrt(x.n * y.n) >= CAST(0.1 AS DOUBLE)",
    "cosine_pairs": f"WITH {RATINGS}, {_PAIRS} SELECT a, b, round(sxy / sqrt(sxx * syy), 6) AS sim FROM p WHERE n >= 5 AND sxy / sqrt(sxx * syy) >= CAST(0.8 AS DOUBLE)",
    "tfidf_topn": f"WITH {_TFIDF} SELECT doc, word, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM prof",
    "profile_cosine": f"""WITH {_TFIDF}, u AS (SELECT DISTINCT lang AS "user", word FROM documents JOIN prof ON source = doc), nu AS (SELECT "user", count(*) AS n FROM u GROUP BY 1), nd AS (SELECT doc, count(*) AS n FROM prof GROUP BY 1),
        q AS (SELECT DISTINCT lang AS "user", source AS doc FROM documents), common AS (SELECT q."user", q.doc, count(*) AS n FROM q JOIN prof ON q.doc = prof.doc JOIN u ON u."user" = q."user" AND u.word = prof.word GROUP BY 1, 2)
        SELECT common."user", common.doc, round(common.n / sqrt(nu.n * nd.n), 6) AS sim FROM common JOIN nu ON nu."user" = common."user" JOIN nd ON nd.doc = common.doc WHERE common.n / sqrt(nu.n * nd.n) >= CAST(0.01 AS DOUBLE)""",
    "bloom_bits": f"SELECT DISTINCT unnest({_positions('p_name')}) AS position FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0)",
    "bloom_probe": f"WITH bits AS (SELECT list(DISTINCT position) AS l FROM (SELECT unnest({_positions('p_name')}) AS position FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0))) SELECT p_partkey, p_name, CAST(list_has_all(l, {_positions('p_name')}) AS INT) AS seen FROM part, bits WHERE p_partkey % 2 = 1",
    "bloom_quality": f"WITH bits AS (SELECT list(DISTINCT position) AS l FROM (SELECT unnest({_positions('c_name')}) AS position FROM customer WHERE c_custkey % 3 = 0)), p AS (SELECT c_custkey % 3 = 0 AS t, list_has_all(l, {_positions('c_name')}) AS s FROM customer, bits) SELECT round(CAST(count(*) FILTER (WHERE NOT t AND s) AS DOUBLE) / count(*) FILTER (WHERE NOT t), 6) AS fpr, round(CAST(count(*) FILTER (WHERE t AND NOT s) AS DOUBLE) / count(*) FILTER (WHERE t), 6) AS fnr FROM p",
    "fm_daily": _fm_sql(),
    "fm_sliding": _fm_sql(f"SELECT w AS window_start, user_id FROM ({_WINDOWS})", "window_start"),
    "sliding_distinct": f"SELECT w AS window_start, count(DISTINCT user_id) AS n FROM ({_WINDOWS}) GROUP BY 1",
    "reservoir_sample": "SELECT event_id, user_id, event_type FROM events ORDER BY md5('3:' || event_id), event_id LIMIT 100",
    "top_tag_levels": 'SELECT tag, "count", level FROM (SELECT *, dense_rank() OVER (ORDER BY "count" DESC) AS level FROM (SELECT user_id AS tag, count(*) AS "count" FROM events GROUP BY 1)) WHERE level <= 3',
    "tags_by_count": """SELECT "count", string_agg(CAST(tag AS VARCHAR), ',' ORDER BY tag) AS tags FROM (SELECT user_id AS tag, count(*) AS "count" FROM events GROUP BY 1) GROUP BY 1""",
}
