"""Recommenders over ratings made of order lines: user, part, stars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.operators import cf, hybrid, lsh, metrics
from ferrule.operators.lineage import drop, forget, written
from ferrule.plans.mining import RATINGS
from ferrule.sources.tables import ratings, table

#: Users with fewer ratings than this have theirs augmented.
FEW = 40
#: Hashes of the user model; with the 50 of the item model's kind it finds 0.82 of the pairs.
USER_HASHES = 90
#: The ratings of these users and items are held out: (user + item) modulo 50 is 0.
_HELD = "(user + item) % 50 = 0"


def _split(spark, d):
    rows = ratings(spark, d)
    return rows.where(f"not ({_HELD})"), rows.where(_HELD)


def _written_split(spark, d):
    """The same, written: to train reads its ratings several times."""
    rows = written(ratings(spark, d))
    return rows.where(f"not ({_HELD})"), rows.where(_HELD)


def _averages(rows):
    return rows.groupBy("item").agg(F.avg("stars").alias("average"))


def pearson_item_model(spark, d):
    return cf.item_model(ratings(spark, d)).select("a", "b", "n", F.round("w", 6).alias("w"))


def pearson_user_model(spark, d):
    """All pairs of users with three parts in common, no buckets."""
    return cf.exact_user_model(ratings(spark, d)).select("a", "b", "n", F.round("w", 6).alias("w"))


def lsh_user_model(spark, d):
    """User pairs that share one of 90 MinHash buckets: nine in ten of pearson_user_model, or more."""
    return cf.user_model(ratings(spark, d), n_hashes=USER_HASHES, numbers=True).select("a", "b", "n", F.round("w", 6).alias("w"))


def cf_item_predict(spark, d):
    train, test = _split(spark, d)
    found = cf.predict_by_items(test, train, cf.item_model(train))
    return found.select("user", "item", F.round("stars", 5).alias("stars"))


def cf_user_predict(spark, d):
    train, test = _split(spark, d)
    found = cf.predict_by_users(test, train, cf.exact_user_model(train))
    return found.select("user", "item", F.round("stars", 5).alias("stars"))


def cf_item_predict_many(spark, d):
    """As cf_item_predict, with up to ten neighbours, of which five at least must be there."""
    train, test = _split(spark, d)
    found = cf.predict_by_items(test, train, cf.item_model(train), 10, 5)
    return found.select("user", "item", F.round("stars", 5).alias("stars"))


def _part_words(spark, d):
    """Parts with the words of their name and type."""
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"), words.alias("words"))


def category_jaccard(spark, d):
    """Pairs of parts whose words of name and type are the same to 0.7."""
    return hybrid.category_similarity(_part_words(spark, d), "item", F.col("words"), 0.7).select("a", "b", F.round("sim", 6).alias("sim"))


def _augmented(spark, d, rows):
    """What users with few ratings, here fewer than most have, would give to parts like those that they rated."""
    classes = hybrid.category_classes(_part_words(spark, d), "item", F.col("words"))
    like = hybrid.class_similarity(classes, 0.7)
    return hybrid.augment(rows, like, _averages(rows), hybrid.overall(rows), below=FEW, least_similar=2, members=classes)


def augment_ratings(spark, d):
    return _augmented(spark, d, ratings(spark, d)).select("user", "item", F.round("stars", 5).alias("stars"))


def _second(test):
    """A predictor of fixed values for two thirds of the pairs, in place of trained factors."""
    value = 1 + F.pmod(F.col("user") * 7 + F.col("item") * 3, F.lit(50)) / 10.0
    return test.select("user", "item", F.when((F.col("user") + F.col("item")) % 3 != 0, value).alias("als"))


def _blended(spark, d):
    train, test = _split(spark, d)
    known = cf.predict_by_items(test, train, cf.item_model(train))
    return hybrid.blend(test, known, _second(test), _averages(train), hybrid.overall(train))


def blend_fallback(spark, d):
    return _blended(spark, d).select("user", "item", F.round("stars", 5).alias("stars"))


def _judged(spark, d):
    train, test = _split(spark, d)
    return test.join(_averages(train), "item", "left")


def rmse(spark, d):
    """Held-out ratings against their items' averages."""
    return metrics.rmse(_judged(spark, d), "stars", "average").select(F.round("rmse", 6).alias("rmse"), "n", "n_missing")


def abs_error_hist(spark, d):
    return metrics.error_histogram(_judged(spark, d), "stars", "average")


def sparsity(spark, d):
    return metrics.sparsity(ratings(spark, d)).select(F.round("sparsity", 9).alias("sparsity"))


def als_predict(spark, d):
    """Held-out ratings by a factor model of rank 1."""
    train, test = _written_split(spark, d)
    model = hybrid.train_als(train)
    return hybrid.predict_factors(model, test).select("user", "item", "als")


def als_centred(spark, d):
    """Held-out ratings by a factor model of stars less the user's mean, as the mean and the product of factors."""
    train, test = _written_split(spark, d)
    means = train.groupBy("user").agg(F.avg("stars").alias("m"))
    found = hybrid.predict_factors(hybrid.train_als(train, rounds=10, centred=True), test).join(means, "user", "left")
    return found.select("user", "item", (F.col("m") + F.col("als")).alias("stars"))


def als_thresholds(spark, d):
    """The error of factor models for each pair of least ratings a user and a part must have, best first."""
    train, test = _written_split(spark, d)
    work: list[str] = []

    def error(model):
        judged = hybrid.predict_factors(model, test).where("not isnan(als) and als is not null")
        return judged.agg(F.sqrt(F.avg(F.pow(F.col("als") - F.col("stars"), 2)))).first()[0] or float("inf")

    def trained(**o):
        # a model before this one has been judged
        drop(spark, work)
        forget(spark)
        return hybrid.train_als(train, **o, keep=work)

    options = [{"least_user": u, "least_item": i, "rounds": 15} for u in (2, 5) for i in (2, 8)]
    found = hybrid.grid(trained, error, options)
    drop(spark, work)
    return spark.createDataFrame([(o["least_user"], o["least_item"], e) for e, o in found], "least_user int, least_item int, rmse double")


def _hybrid(spark, d):
    """Held-out pairs, what augmenting the training ratings says of them, and the factors trained on both."""
    train, test = _written_split(spark, d)
    more = written(_augmented(spark, d, train))
    model = hybrid.train_als(train.unionByName(more.join(train, ["user", "item"], "left_anti")))
    return train, test, more, hybrid.predict_factors(model, test)


def hybrid_predict(spark, d):
    """Augmented ratings and trained factors, blended, with fallbacks; held-out ratings have no part in any of it."""
    train, test, more, factors = _hybrid(spark, d)
    return hybrid.blend(test, more, factors, _averages(train), hybrid.overall(train))


def overlap_of_splits(spark, d):
    """Pairs that are in both splits: none."""
    train, test = _split(spark, d)
    return test.join(train, ["user", "item"], "left_semi").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pearson_item_model, pearson_user_model, lsh_user_model, cf_item_predict, cf_user_predict, cf_item_predict_many, category_jaccard, augment_ratings, blend_fallback, rmse, abs_error_hist, sparsity, als_predict, als_centred, als_thresholds, hybrid_predict, overlap_of_splits)}

_SUMS = "count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy, sum(x.stars * y.stars) AS sxy"
_W = "CASE WHEN sxx - sx * sx / n > CAST(1e-9 AS DOUBLE) AND syy - sy * sy / n > CAST(1e-9 AS DOUBLE) THEN (sxy - sx * sy / n) / sqrt((sxx - sx * sx / n) * (syy - sy * sy / n)) END"


def _model(rows: str, key: str, item: str, name: str = "m") -> str:
    """The SQL of a Pearson model of `rows`; keys of at least three items."""
    e = f"e{name} AS (SELECT * FROM {rows} WHERE {key} IN (SELECT {key} FROM {rows} GROUP BY 1 HAVING count(*) >= 3))"
    return f"{e}, {name} AS (SELECT a, b, n, w FROM (SELECT a, b, n, {_W} AS w FROM (SELECT x.{key} AS a, y.{key} AS b, {_SUMS} FROM e{name} x JOIN e{name} y ON x.{item} = y.{item} AND x.{key} < y.{key} GROUP BY 1, 2 HAVING count(*) >= 3)) WHERE w > CAST(1e-9 AS DOUBLE))"


_SPLIT = f'{RATINGS}, train AS (SELECT * FROM r WHERE ("user" + item) % 50 <> 0), test AS (SELECT * FROM r WHERE ("user" + item) % 50 = 0)'
_AVERAGES = "av AS (SELECT item, avg(stars) AS average FROM train GROUP BY 1)"


def _by_items(n: int, least: int) -> str:
    return f"""{_model("train", "item", '"user"')}, mm AS (SELECT a, b, w FROM m UNION ALL SELECT b, a, w FROM m),
        f AS (SELECT t."user", t.item, o.stars, mm.w, row_number() OVER (PARTITION BY t."user", t.item ORDER BY round(mm.w, 9) DESC, o.item) AS k FROM test t JOIN train o ON o."user" = t."user" AND o.item <> t.item JOIN mm ON mm.a = t.item AND mm.b = o.item),
        pi AS (SELECT "user", item, sum(w * stars) / sum(w) AS stars FROM f WHERE k <= {n} GROUP BY 1, 2 HAVING count(*) >= {least})"""


_WORDS = "wd AS (SELECT DISTINCT p_partkey AS key, word FROM (SELECT p_partkey, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part) WHERE word <> ''), wn AS (SELECT key, count(*) AS n FROM wd GROUP BY 1), ws AS (SELECT a, b, CAST(c AS DOUBLE) / (x.n + y.n - c) AS sim FROM (SELECT x.key AS a, y.key AS b, count(*) AS c FROM wd x JOIN wd y ON x.word = y.word AND x.key < y.key GROUP BY 1, 2) JOIN wn x ON x.key = a JOIN wn y ON y.key = b WHERE CAST(c AS DOUBLE) / (x.n + y.n - c) >= CAST(0.7 AS DOUBLE))"

_USER_BUCKETS = lsh.sql('SELECT "user" AS key, item AS x FROM r', USER_HASHES)
_COMMON_USERS = """k3 AS (SELECT * FROM r WHERE "user" IN (SELECT "user" FROM r GROUP BY 1 HAVING count(*) >= 3)), zn AS (SELECT "user", count(*) AS n FROM k3 GROUP BY 1),
    cc AS (SELECT cand.a, cand.b, count(*) AS n FROM cand JOIN k3 x ON x."user" = cand.a JOIN k3 y ON y."user" = cand.b AND y.item = x.item GROUP BY 1, 2),
    close AS (SELECT a, b FROM cc JOIN zn x ON x."user" = a JOIN zn y ON y."user" = b WHERE CAST(cc.n AS DOUBLE) / (x.n + y.n - cc.n) >= CAST(0.01 AS DOUBLE))"""
SQL = {
    "lsh_user_model": f"""WITH {RATINGS}, {_USER_BUCKETS}, {_COMMON_USERS}, {_model("r", '"user"', "item")} SELECT a, b, n, round(w, 6) AS w FROM m SEMI JOIN close USING (a, b)""",
    "pearson_item_model": f"""WITH {RATINGS}, {_model("r", "item", '"user"')} SELECT a, b, n, round(w, 6) AS w FROM m""",
    "pearson_user_model": f"""WITH {RATINGS}, {_model("r", '"user"', "item")} SELECT a, b, n, round(w, 6) AS w FROM m""",
    "cf_item_predict": f'WITH {_SPLIT}, {_by_items(3, 1)} SELECT "user", item, round(stars, 5) AS stars FROM pi',
    "cf_item_predict_many": f'WITH {_SPLIT}, {_by_items(10, 5)} SELECT "user", item, round(stars, 5) AS stars FROM pi',
    "cf_user_predict": f"""WITH {_SPLIT}, {_model("train", '"user"', "item")}, mm AS (SELECT a, b, w FROM m UNION ALL SELECT b, a, w FROM m), tot AS (SELECT "user", sum(stars) AS s, count(*) AS c FROM train GROUP BY 1),
        f AS (SELECT t."user", t.item, mm.w, o.stars - (g.s - o.stars) / (g.c - 1) AS gap, row_number() OVER (PARTITION BY t."user", t.item ORDER BY round(mm.w, 9) DESC, o."user") AS k FROM test t JOIN train o ON o.item = t.item AND o."user" <> t."user" JOIN tot g ON g."user" = o."user" AND g.c > 1 JOIN mm ON mm.a = t."user" AND mm.b = o."user"),
        p AS (SELECT f."user", f.item, any_value(tot.s / tot.c) + sum(w * gap) / sum(w) AS stars FROM f JOIN tot ON tot."user" = f."user" WHERE k <= 5 GROUP BY 1, 2) SELECT "user", item, round(stars, 5) AS stars FROM p WHERE stars BETWEEN 0 AND 5""",
    "category_jaccard": f"WITH {_WORDS} SELECT a, b, round(sim, 6) AS sim FROM ws",
    "augment_ratings": f"""WITH {RATINGS}, {_WORDS}, av AS (SELECT item, avg(stars) AS average FROM r GROUP BY 1), un AS (SELECT avg(stars) AS u FROM r),
        few AS (SELECT "user" FROM r GROUP BY 1 HAVING count(*) >= 3 AND count(*) < {FEW}), s2 AS (SELECT a, b, sim FROM ws UNION ALL SELECT b, a, sim FROM ws),
        f AS (SELECT o."user", s2.b AS item, o.stars, sim, coalesce(x.average, u) AS ar, coalesce(y.average, u) AS ai FROM r o JOIN few ON few."user" = o."user" JOIN s2 ON s2.a = o.item LEFT JOIN av x ON x.item = o.item LEFT JOIN av y ON y.item = s2.b, un WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q."user" = o."user" AND q.item = s2.b))
        SELECT "user", item, round(least(5.0, sum(stars * CASE WHEN ar > ai THEN sim ELSE 1 / sim END) / sum(sim)), 5) AS stars FROM f GROUP BY 1, 2 HAVING count(*) >= 2""",
    "blend_fallback": f"""WITH {_SPLIT}, {_by_items(3, 1)}, {_AVERAGES}, q AS (SELECT "user", item, CASE WHEN ("user" + item) % 3 <> 0 THEN 1 + (("user" * 7 + item * 3) % 50) / CAST(10.0 AS DOUBLE) END AS als FROM test),
        x AS (SELECT t."user", t.item, coalesce(CAST(0.3 AS DOUBLE) * pi.stars + CAST(0.7 AS DOUBLE) * q.als, pi.stars, q.als) AS v, average FROM test t LEFT JOIN pi ON pi."user" = t."user" AND pi.item = t.item LEFT JOIN q ON q."user" = t."user" AND q.item = t.item LEFT JOIN av ON av.item = t.item)
        SELECT "user", item, round(coalesce(CASE WHEN v IS NOT NULL THEN greatest(0.0, least(5.0, v)) END, average, (SELECT avg(stars) FROM train)), 5) AS stars FROM x""",
    "rmse": f"WITH {_SPLIT}, {_AVERAGES} SELECT round(sqrt(avg(pow(stars - average, 2))), 6) AS rmse, count(average) AS n, count(*) FILTER (WHERE average IS NULL) AS n_missing FROM test LEFT JOIN av USING (item)",
    "abs_error_hist": f"WITH {_SPLIT}, {_AVERAGES} SELECT CAST(least(floor(abs(stars - average)), 4) AS BIGINT) AS bin, count(*) AS n FROM test JOIN av USING (item) GROUP BY 1",
    "sparsity": f'WITH {RATINGS} SELECT round(1 - CAST(count(*) AS DOUBLE) / (count(DISTINCT "user") * count(DISTINCT item)), 9) AS sparsity FROM r',
    "overlap_of_splits": f'WITH {_SPLIT} SELECT count(*) AS n FROM test JOIN train ON train."user" = test."user" AND train.item = test.item',
}
