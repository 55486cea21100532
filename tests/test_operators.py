import json
import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ferrule.functions import scalars, text
from ferrule.operators import cf, cluster, graph, hybrid, itemsets, lsh, metrics, pairs, profiles, relational, sketch
from ferrule.sources import readers, sinks
from ferrule.streaming import windows

TOY = [("A", "B"), ("A", "C"), ("B", "C"), ("B", "D"), ("D", "E"), ("D", "F"), ("D", "G"), ("E", "F"), ("F", "G")]
GOLDEN = {"AB": 5, "AC": 1, "BC": 5, "BD": 12, "DE": 4.5, "DF": 4, "DG": 4.5, "EF": 1.5, "FG": 1.5}


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame(TOY, "u string, v string")


def test_betweenness_golden_in_both_forms(toy, monkeypatch):
    for most in (graph.LOCAL_EDGES, 2):
        monkeypatch.setattr(graph, "LOCAL_EDGES", most)
        got = {r.u + r.v: r.betweenness for r in graph.edge_betweenness(toy).collect()}
        assert got.keys() == GOLDEN.keys() and all(abs(got[k] - v) < 1e-9 for k, v in GOLDEN.items())


def test_girvan_newman_in_both_forms(toy, monkeypatch):
    for most in (graph.LOCAL_EDGES, 2):
        monkeypatch.setattr(graph, "LOCAL_EDGES", most)
        got = {r.id: r.component for r in graph.girvan_newman(toy).collect()}
        assert got == dict.fromkeys("ABC", "A") | dict.fromkeys("DEFG", "D")


def test_components_with_isolates(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (8, 9), (9, 10), (10, 8)], "u long, v long")
    vertices = spark.createDataFrame([(5,), (1,)], "id long")
    got = {r.id: r.component for r in graph.components(edges, vertices).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 8: 8, 9: 8, 10: 8}
    assert [r.id for r in graph.isolated(vertices, edges).collect()] == [5]
    groups = graph.components(edges)
    q = graph.modularity(groups, edges).first().q
    assert abs(q - sum(e / 5 - (d / 10) ** 2 for e, d in ((2, 4), (3, 6)))) < 1e-12


def test_label_propagation_and_graph_edits(spark, toy):
    labels = {r.id: r.label for r in graph.label_propagation(toy).collect()}
    assert set(labels) == set("ABCDEFG") and set(labels.values()) <= set("ABCDEFG")
    less = graph.remove_edges(toy, spark.createDataFrame([("D", "B")], "u string, v string"))
    assert less.count() == 8 and graph.add_edges(less, toy).count() == 9
    sizes = [(r.size, r.members[0]) for r in graph.communities(graph.components(less), "component").collect()]
    assert sizes == [(3, "A"), (4, "D")]


def _brute_sets(baskets, support, longest):
    items = sorted({x for b in baskets for x in b})
    out = {}
    for k in range(1, longest + 1):
        for c in combinations(items, k):
            n = sum(set(c) <= b for b in baskets)
            if n >= support:
                out[c] = n
    return out


def test_itemsets_agree(spark):
    rng = random.Random(2)
    baskets = [set(rng.choices(range(1, 14), k=rng.randint(1, 8))) for _ in range(60)]
    rows = spark.createDataFrame([(i, x) for i, b in enumerate(baskets) for x in b], "basket int, item int")
    want = _brute_sets(baskets, 9, 8)
    assert {tuple(r["items"]): r.support for r in itemsets.frequent(rows, 9).collect()} == want
    assert {tuple(r["items"]): r.support for r in itemsets.by_partitions(rows, 9, 3).collect()} == want
    assert {tuple(r["items"]): r.support for r in itemsets.hashed_pairs(rows, 9, 7).collect()} == {k: v for k, v in want.items() if len(k) == 2}
    found = {tuple(r["items"]) for r in itemsets.partition_candidates(rows, 9, 3).collect()}
    assert set(want) <= found


def test_report_is_in_string_order(spark, tmp_path):
    sets = spark.createDataFrame([(["97"], 5), (["100"], 5), (["97", "100"], 4), (["100", "98"], 4)], "items array<string>, support int")
    lines = {r.size: r.line for r in itemsets.report_lines(sets).collect()}
    assert lines == {1: "('100'),('97')", 2: "('100', '97'),('100', '98')"}
    sinks.itemset_report(sets, sets.where("size(items) = 1"), f"{tmp_path}/r")
    assert open(f"{tmp_path}/r").read() == "Candidates:\n('100'),('97')\n\n('100', '97'),('100', '98')\n\nFrequent Itemsets:\n('100'),('97')\n\n"


def test_baskets(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("c", None)], "k string, v string")
    assert sorted(tuple(r) for r in itemsets.baskets(rows, "k", "v").collect()) == [("a", "x"), ("a", "y"), ("b", "x")]
    assert {r.basket for r in itemsets.baskets(rows, "k", "v", 1).collect()} == {"a"}


RATED = [(u, "i", float(s)) for u, s in zip("abc", (1, 2, 3), strict=True)] + [(u, "j", float(s)) for u, s in zip("abc", (2, 3, 5), strict=True)] + [(u, "flat", 3.0) for u in "abc"] + [("a", "two", 1.0), ("b", "two", 5.0)]


def test_pearson_edges(spark):
    rows = spark.createDataFrame(RATED, "user string, item string, stars double")
    got = {(r.a, r.b): r.w for r in pairs.pearson(rows, "item", "user", "stars").collect()}
    assert got.keys() == {("i", "j")} and abs(got["i", "j"] - 0.98198) < 1e-4
    sims = {(r.a, r.b): r.sim for r in pairs.jaccard(rows, "item", "user", 0.5).collect()}
    assert sims["i", "j"] == 1 and abs(sims["i", "two"] - 2 / 3) < 1e-9


def test_predictions_by_hand(spark):
    ratings = spark.createDataFrame([("u", "x", 4.0), ("u", "y", 2.0), ("v", "t", 5.0), ("v", "x", 3.0), ("w", "t", 1.0), ("w", "y", 4.0)], "user string, item string, stars double")
    wanted = spark.createDataFrame([("u", "t"), ("nobody", "t"), ("u", "unknown")], "user string, item string")
    by_item = spark.createDataFrame([("t", "x", 0.8), ("t", "y", 0.2)], "a string, b string, w double")
    got = [tuple(r) for r in cf.predict_by_items(wanted, ratings, by_item).collect()]
    assert got == [("u", "t", pytest.approx((0.8 * 4 + 0.2 * 2) / 1.0))]
    assert not cf.predict_by_items(wanted, ratings, by_item, 10, 3).collect()
    by_user = spark.createDataFrame([("u", "v", 0.5), ("u", "w", 0.25)], "a string, b string, w double")
    got = [tuple(r) for r in cf.predict_by_users(wanted, ratings, by_user).collect()]
    assert got == [("u", "t", pytest.approx(3 + (0.5 * (5 - 3) + 0.25 * (1 - 4)) / 0.75))]


def test_lsh_candidates(spark):
    rows = spark.createDataFrame([("S1", 0), ("S1", 3), ("S2", 2), ("S3", 1), ("S3", 3), ("S3", 4), ("S4", 0), ("S4", 2), ("S4", 3)], "k string, x int")
    sig = {r.key: r.sig for r in lsh.signatures(rows, "k", "x", [(1, 1), (3, 1)], 5, numbers=True).collect()}
    assert sig == {"S1": [1, 0], "S2": [3, 2], "S3": [0, 0], "S4": [1, 0]}
    twins = spark.createDataFrame([(k, i) for k in ("a", "b") for i in range(30)] + [("c", 100 + i) for i in range(30)], "k string, x int")
    got = [(r.a, r.b, r.sim) for r in lsh.similar(twins, "k", "x").collect()]
    assert got == [("a", "b", 1.0)]


def test_profiles(spark):
    docs = spark.createDataFrame([("d1", "The cat, the DOG! cat"), ("d2", "dog bird"), ("d1", "cat")], "doc string, text string")
    stop = spark.createDataFrame([("the",)], "word string")
    counts = profiles.word_counts(docs, "doc", "text", stop)
    assert {(r.doc, r.word): r.n for r in counts.collect()} == {("d1", "cat"): 3, ("d1", "dog"): 1, ("d2", "dog"): 1, ("d2", "bird"): 1}
    weights = {(r.doc, r.word): r.weight for r in profiles.tfidf(counts, 2).collect()}
    assert weights["d1", "cat"] == 1 and weights["d1", "dog"] == 0 and weights["d2", "bird"] == 1
    assert {r.word for r in profiles.drop_rare_words(counts, 0.2).collect()} == {"cat", "dog"}


def test_augmentation_bounds(spark):
    like = [("a", "t", 0.8), ("b", "t", 0.9), ("c", "t", 1.0)]
    rows = []
    for u, n in (("two", 2), ("three", 3), ("seven", 7), ("eight", 8)):
        rows += [(u, x, 4.0) for x in "abc"[: min(n, 3)]] + [(u, f"o{i}", 3.0) for i in range(n - 3)]
    ratings = spark.createDataFrame(rows, "user string, item string, stars double")
    sims = spark.createDataFrame(like, "a string, b string, sim double")
    averages = spark.createDataFrame([("a", 4.0), ("t", 3.9), ("b", 1.0)], "item string, average double")
    got = {(r.user, r.item): r.stars for r in hybrid.augment(ratings, sims, averages, 3.0).collect()}
    want = min(5.0, (4 * 0.8 + 4 / 0.9 + 4 / 1.0) / 2.7)
    assert got == {("three", "t"): pytest.approx(want), ("seven", "t"): pytest.approx(want)}


def test_augmentation_by_nearest(spark):
    ratings = spark.createDataFrame([("u", "a", 5.0), ("u", "b", 1.0), ("v", "t", 3.0)], "user string, item string, stars double")
    sims = spark.createDataFrame([("a", "t", 0.5), ("b", "t", 0.9)], "a string, b string, sim double")
    averages = spark.createDataFrame([("a", 4.0), ("b", 4.0), ("t", 3.0)], "item string, average double")
    one = hybrid.augment(ratings, sims, averages, 3.0, least=1, below=3, least_similar=1, nearest=1).where("item = 't'").collect()
    assert [tuple(r) for r in one] == [("u", "t", 1.0)]


def test_blend_and_first_model(spark):
    wanted = spark.createDataFrame([("u", x) for x in "abcde"], "user string, item string")
    known = spark.createDataFrame([("u", "a", 5.0), ("u", "b", 9.0)], "user string, item string, stars double")
    factors = spark.createDataFrame([("u", "a", 1.0), ("u", "c", -2.0), ("u", "d", None)], "user string, item string, als double")
    averages = spark.createDataFrame([("d", 2.5)], "item string, average double")
    got = {r.item: r.stars for r in hybrid.blend(wanted, known, factors, averages, 3.7).collect()}
    assert got == {"a": pytest.approx(2.2), "b": 5.0, "c": 0.0, "d": 2.5, "e": 3.7}
    first = hybrid.first_model(wanted, [known, averages.selectExpr("'u' as user", "item", "average as stars")])
    assert {r.item: r.stars for r in first.collect()} == {"a": 5.0, "b": 9.0, "c": None, "d": 2.5, "e": None}
    assert hybrid.grid(lambda x: x * x, lambda m: abs(m - 9), [{"x": 1}, {"x": 3}])[0] == (0, {"x": 3})


def test_kmeans_and_bfr(spark):
    rng = random.Random(3)
    centres = [(0, 0), (50, 0), (0, 50)]
    points = [(i, [c[0] + rng.gauss(0, 1), c[1] + rng.gauss(0, 1)]) for i, c in enumerate(rng.choices(centres, k=400))]
    points += [(900, [500.0, 500.0])]
    df = spark.createDataFrame(points, "idx long, attrs array<double>")
    tagged, centroids = cluster.kmeans(df.where("idx < 900"), 3)
    truth = {i: min(range(3), key=lambda c: math.dist(p, centres[c])) for i, p in points if i < 900}
    pairs_seen = {(truth[r.idx], r.tag) for r in tagged.collect()}
    assert len(pairs_seen) == 3 and len(centroids) == 3
    chunks = [df.where(F.floor(F.col("idx") / 150) == i) for i in range(2)] + [df.where("idx >= 300")]
    labels, stats = cluster.bfr(chunks, 3)
    got = {r.idx: r.label for r in labels.collect()}
    assert got.keys() == {i for i, _ in points} and got[900] == -1
    good = [(truth[i], x) for i, x in got.items() if x >= 0 and i < 900]
    assert len(set(good)) == 3 and len(good) > 380
    taken = 0
    for r, chunk in zip(stats.orderBy("round").collect(), chunks, strict=True):
        taken += chunk.count()
        assert r.discard_points + r.compressed_points + r.retained_points == taken


def test_mahalanobis_without_deviation(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [0.0, 2.0])], "p array<double>, m array<double>, s array<double>")
    assert row.select(cluster.mahalanobis(F.col("p"), F.col("m"), F.col("s"))).first()[0] == pytest.approx(math.sqrt(9 + 4))


def test_metrics(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, None), (0.0, 4.5)], "y double, p double")
    r = metrics.rmse(rows, "y", "p").first()
    assert (r.rmse, r.n, r.n_missing) == (pytest.approx(math.sqrt((1 + 0 + 20.25) / 3)), 3, 1)
    assert {r.bin: r.n for r in metrics.error_histogram(rows, "y", "p").collect()} == {0: 1, 1: 1, 4: 1}
    labels = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (1, "b")], "x int, y string")
    for how in ("geometric", "arithmetic"):
        assert metrics.nmi(labels, "x", "y", how).first().nmi == pytest.approx(1)
    flags = spark.createDataFrame([(True, True), (False, True), (False, False), (False, False)], "t boolean, s boolean")
    assert tuple(metrics.filter_quality(flags, "t", "s").first()) == (pytest.approx(1 / 3), 0.0)


def test_scalars(spark):
    rows = spark.createDataFrame([("",), ("Las Vegas",), ("Zürich",), (None,)], "s string")
    got = [r[0] for r in rows.select(scalars.utf8_mod(F.col("s"), 1_000_003)).collect()]
    assert got == [0, *(int.from_bytes(s.encode(), "big") % 1_000_003 for s in ("Las Vegas", "Zürich")), None]
    n = spark.createDataFrame([(0,), (1,), (12,), (1 << 40,)], "n long").select(scalars.trailing_zeros(F.col("n")), scalars.popcount(F.col("n")), scalars.bit(F.col("n"), F.lit(2)), scalars.with_bit(F.col("n"), 0))
    assert [tuple(r) for r in n.collect()] == [(0, 0, 0, 1), (0, 1, 0, 1), (2, 2, 1, 13), (40, 1, 0, (1 << 40) + 1)]
    x = spark.createDataFrame([(-1.0,), (2.5,), (7.0,), (None,)], "x double")
    assert [tuple(r) for r in x.select(scalars.clip(F.col("x"), 0, 5), scalars.within(F.col("x"), 0, 5), scalars.half_even(F.col("x"))).collect()] == [(0.0, None, -1.0), (2.5, 2.5, 2.0), (5.0, None, 7.0), (None, None, None)]
    assert [scalars.next_prime(n) for n in (1, 7, 26184)] == [2, 11, 26189]
    t = spark.createDataFrame([("It's (a) Test, x.y!",)], "t string")
    assert t.select(text.split_words(F.col("t")), text.letter_words(F.col("t")), text.parts(F.lit("a , b"))).first()[:] == (["it's", "a", "test", "x", "y"], ["it", "s", "a", "test", "x", "y"], ["a", "b"])


def test_relational(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2), ("d", 1), ("e", 0)], "tag string, count int")
    assert {r.tag: r.level for r in relational.top_levels(rows, 2).collect()} == {"a": 1, "b": 1, "c": 2}
    assert {r["count"]: r["values"] for r in relational.values_by_count(rows, "tag").collect()}[3] == ["a", "b"]
    ratings = spark.createDataFrame([(u, i) for u in range(4) for i in range(u + 1)], "user int, item int")
    assert sorted(tuple(r) for r in relational.drop_rare(ratings, {"user": 3, "item": 3}).collect()) == [(2, 0), (2, 1), (3, 0), (3, 1)]
    names = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "s string").repartition(3)
    assert {r.s: r["index"] for r in relational.dictionary(names, "s").collect()} == {"a": 0, "b": 1, "c": 2}
    assert [r.n_items for r in relational.partition_sizes(spark.range(3).repartition(2)).orderBy("partition").collect()] in ([1, 2], [2, 1])


def test_bloom_and_distinct_counts(spark):
    names = spark.createDataFrame([(i, f"city {i}") for i in range(300)] + [(300, ""), (301, None), (302, "Zürich")], "i long, city string")
    filled = sketch.bloom_bits(names.where("i % 2 = 0"), "city")
    probed = sketch.bloom_probe(names, "city", filled).collect()
    assert all(r.seen == 1 for r in probed if r.i % 2 == 0 and r.city) and all(r.seen == 0 for r in probed if not r.city)
    assert sum(r.seen for r in probed if r.i % 2) < 10
    estimate = sketch.fm_distinct(names.withColumn("k", F.lit(1)), ["k"], "city").first().estimate
    assert 300 / 6 < estimate < 300 * 6
    bits = sinks.bit_string(spark.createDataFrame([(2, 0), (1, 1), (3, 1)], "o int, b int"), "o", "b").first().bits
    assert bits == "1 0 1"


def test_counts_by_clusters():
    assert sketch.line_clusters([1, 2, 10, 11, 50], 3) == [[1, 2], [50], [10, 11]]
    assert sketch.fm_clustered([3, 3, 3, 3]) == 8 and sketch.fm_clustered([]) == 0
    assert sketch.fm_clustered([2, 2, 4, 4], 2) == 8 and sketch.fm_clustered([2, 2, 4, 4], 2, powers=True) == 10


def test_reservoir_is_uniform_and_stable(spark):
    rows = spark.range(2000).withColumnRenamed("id", "k")
    one = {r.k for r in sketch.reservoir(rows, 200, "k").collect()}
    assert one == {r.k for r in sketch.reservoir(rows.repartition(7), 200, "k").collect()} and len(one) == 200
    assert 60 < sum(k < 1000 for k in one) < 140


def test_readers_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "b,1"), ("u2", None)], readers.PAIR)
    sinks.csv_with_header(rows, f"{tmp_path}/c")
    assert sorted(map(str, readers.headed_csv(spark, f"{tmp_path}/c").collect())) == sorted(map(str, rows.collect()))
    sinks.json_lines(rows.selectExpr("user_id as b1", "'x' as b2", "0.5D as sim"), f"{tmp_path}/j")
    assert readers.pair_model(spark, f"{tmp_path}/j", "b1", "b2").count() == 2
    assert readers.json_lines(spark, f"{tmp_path}/j", "b1 string, absent int").where("absent is null").count() == 2
    (tmp_path / "v").mkdir()
    (tmp_path / "v/2.txt").write_text("7,1.5,-2\n\n8,0,1e3\n")
    (tmp_path / "v/1.txt").write_text("9,3,4\n")
    chunks = readers.vector_chunks(spark, f"{tmp_path}/v")
    assert [[(r.idx, r.attrs) for r in c.orderBy("idx").collect()] for c in chunks] == [[(9, [3.0, 4.0])], [(7, [1.5, -2.0]), (8, [0.0, 1000.0])]]
    (tmp_path / "m").write_text('{"a": 1.5, "UNK": 3.0}')
    assert {r.key: r.value for r in readers.json_map(spark, f"{tmp_path}/m").collect()} == {"a": 1.5, "UNK": 3.0}
    (tmp_path / "w").write_text("the\nof \n\nthe\n")
    assert {r.word for r in readers.word_list(spark, f"{tmp_path}/w").collect()} == {"the", "of"}
    sinks.json_object(spark.createDataFrame([(1, [2])], "A int, B array<int>"), f"{tmp_path}/o")
    assert json.load(open(f"{tmp_path}/o")) == {"A": 1, "B": [2]}
    sinks.table(rows, f"{tmp_path}/t")
    assert readers.table_model(spark, f"{tmp_path}/t").count() == 2
    named = sinks.named_pairs(spark.createDataFrame([(0, 1, 0.5)], "a int, b int, sim double"), spark.createDataFrame([(0, "x"), (1, "y")], "n int, name string"), "n", "name")
    assert named.first().asDict() == {"sim": 0.5, "a": "x", "b": "y"}
    line = spark.range(1).select(sinks.community_line(F.array(F.lit("a"), F.lit("b"))), sinks.betweenness_line(F.lit("a"), F.lit("b"), F.lit(1.5))).first()
    assert line[:] == ("'a', 'b'", "('a', 'b'), 1.5")


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 00:00:{i:02d}", f"c{i % 9}", i, ["a", "b"][: i % 3]) for i in range(60)], "t string, city string, k long, tags array<string>").selectExpr("cast(t as timestamp) as ts", "city", "k", "tags")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = readers.file_stream(spark, f"{tmp_path}/in", events.schema, files=1)
    query = windows.sliding_distinct(stream, "ts", "city", late="1 minute").writeStream.format("memory").queryName("sliding").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    batch = {r.window_start: (r.estimate, r.approx) for r in windows.sliding_distinct(events, "ts", "city").collect()}
    assert {r.window_start: (r.estimate, r.approx) for r in spark.table("sliding").collect()} == batch and len(batch) == 8
    keep = windows.Reservoir(20, "k", f"{tmp_path}/sample")
    stream = readers.file_stream(spark, f"{tmp_path}/in", events.schema, files=1)
    windows.start(windows.english_tags(stream, "tags"), keep, f"{tmp_path}/c2", None).awaitTermination(120)
    some = windows.english_tags(events, "tags")
    assert keep.seen(spark) == some.count()
    sample = keep.sample(spark, events.schema)
    assert {r.k for r in sample.collect()} == {r.k for r in sketch.reservoir(some, 20, "k").collect()}
    top = windows.leading_tags(sample, "tags").collect()
    assert top[0]["values"] == ["a"] and top[0]["count"] == 20


def test_reservoir_outlives_its_process(spark, tmp_path):
    rows = spark.range(1050).selectExpr("id as k", "array(concat('t', id % 7)) as tags")
    windows.Reservoir(50, "k", f"{tmp_path}/r")(rows.where("k < 1000"), 0)
    again = windows.Reservoir(50, "k", f"{tmp_path}/r")  # a new process, whose first batch is repeated
    again(rows.where("k >= 1000"), 1)
    again(rows.where("k >= 1000"), 1)
    assert again.seen(spark) == 1050
    assert {r.k for r in again.sample(spark, rows.schema).collect()} == {r.k for r in sketch.reservoir(rows, 50, "k").collect()}
    first = sketch.reservoir(rows.where("k < 1000"), 50, "k")
    counts = first.selectExpr("explode(tags) as tag").groupBy("tag").count()
    kept = windows.update_counts(counts, first, again.sample(spark, rows.schema), "k", "tags")
    want = again.sample(spark, rows.schema).selectExpr("explode(tags) as tag").groupBy("tag").count()
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    report = windows.TagReport(windows.Reservoir(50, "k", f"{tmp_path}/q"), "tags", f"{tmp_path}/tags.txt", 1)
    report(rows.where("k < 4"), 0)
    report(rows.where("k >= 4 and k < 8"), 1)
    head = "The number of tweets with tags from the beginning: "
    assert open(f"{tmp_path}/tags.txt").read() == head + "4\nt0  : 1\nt1  : 1\nt2  : 1\nt3  : 1\n\n" + head + "8\nt0  : 2\n\n"
    lines = windows.WindowReport("k", f"{tmp_path}/w")
    lines(rows, 0)
    lines(rows.limit(0), 1)
    got = spark.read.option("header", True).csv(f"{tmp_path}/w").orderBy("Time").collect()
    assert sorted(int(r["Ground Truth"]) for r in got) == [0, 1050]
    assert windows.keyword_stream(spark.createDataFrame([("COVID x",), ("y",), (None,)], "t string"), "t", "covid").count() == 1


def test_report_files(spark, tmp_path):
    edges = spark.createDataFrame([("b", "c", 1.5), ("a", "c", 2.0), ("a", "b", 1.5)], "u string, v string, betweenness double")
    sinks.betweenness_file(edges, f"{tmp_path}/b")
    assert open(f"{tmp_path}/b").read() == "('a', 'c'), 2.0\n('a', 'b'), 1.5\n('b', 'c'), 1.5\n"
    sinks.label_object(spark.createDataFrame([(10, 1), (9, -1)], "idx long, label long"), f"{tmp_path}/l")
    assert open(f"{tmp_path}/l").read() == '{"9": -1, "10": 1}'
    stats = spark.createDataFrame([(1, 2, 3, 4, 5, 6), (0, 1, 1, 0, 0, 9)], cluster.STATS)
    sinks.round_csv(stats, f"{tmp_path}/s")
    assert open(f"{tmp_path}/s").read().splitlines()[1:] == ["0,1,1,0,0,9", "1,2,3,4,5,6"]
    sinks.profile_model(edges, stats, f"{tmp_path}/m")
    assert [x.count() for x in sinks.read_profile_model(spark, f"{tmp_path}/m")] == [3, 2]


def test_factor_models_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(12) for i in range(10) if (u + i) % 4], "user long, item long, stars double")
    model = hybrid.train_als(rows, least_user=1, least_item=1, rounds=3)
    want = sorted(map(tuple, hybrid.predict_factors(model, rows.select("user", "item")).collect()))
    hybrid.save_factors(model, f"{tmp_path}/f")
    hybrid.save_model(model, f"{tmp_path}/n")
    for again in (hybrid.Factors(spark, f"{tmp_path}/f"), hybrid.load_model(f"{tmp_path}/n")):
        assert sorted(map(tuple, hybrid.predict_factors(again, rows.select("user", "item")).collect())) == want
    few, many = hybrid.by_number(rows, "user", 8)
    assert few.count() + many.count() == rows.count() and few.select("user").distinct().count() + many.select("user").distinct().count() == 12
    assert hybrid.most_of_duplicates(rows.union(rows.withColumn("stars", rows.stars + 1))).agg({"stars": "min"}).first()[0] == 2.0


def test_english_tags(spark):
    rows = spark.createDataFrame([(1, []), (2, ["covid", "x"]), (3, ["ok", "ж"]), (4, None)], "i int, tags array<string>")
    assert [r.i for r in windows.english_tags(rows, "tags").collect()] == [2]
