"""What keeps steps in proportion to their input: pairs that aren't shuffled, long lists that are dealt out, classes of equal items."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ferrule.operators import cf, hybrid, itemsets, lsh, pairs, sketch
from ferrule.plans import graphs, recommend


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _ratings(spark, users=40, items=25, seed=1):
    rng = random.Random(seed)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(users) for i in range(items) if rng.random() < 0.3 or i == 0]
    return rows, spark.createDataFrame(rows, "user bigint, item bigint, stars double")


def _by_hand(rows):
    """n, sums and sizes of all pairs of users, by brute force."""
    of = {}
    for u, i, s in rows:
        of.setdefault(u, {})[i] = s
    out = {}
    for a, b in combinations(sorted(of), 2):
        both = of[a].keys() & of[b].keys()
        if both:
            x, y = [of[a][i] for i in both], [of[b][i] for i in both]
            out[a, b] = (len(both), sum(x), sum(y), sum(v * v for v in x), sum(v * v for v in y), sum(p * q for p, q in zip([of[a][i] for i in both], [of[b][i] for i in both], strict=True)), len(of[a]), len(of[b]))
    return out


@pytest.mark.parametrize("longest", [512, 4])
def test_pairs_of_long_lists(spark, monkeypatch, longest):
    """The same pairs whether an item's keys stand in one list or, as item 0's, in many."""
    monkeypatch.setattr(pairs, "LIST", longest)
    rows, ratings = _ratings(spark)
    got = {(r.a, r.b): tuple(r)[2:] for r in pairs.pairs(ratings, "user", "item", "stars", sized=True).collect()}
    assert got == _by_hand(rows)
    names = pairs.pairs(ratings.select(F.concat(F.lit("u"), "user").alias("user"), "item"), "user", "item", least=3)
    assert {(r.a, r.b): r.n for r in names.collect()} == {tuple(sorted((f"u{a}", f"u{b}"))): v[0] for (a, b), v in _by_hand(rows).items() if v[0] >= 3}


def test_pairs_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIRS", 100)
    _, ratings = _ratings(spark)
    for found in (pairs.jaccard(ratings, "user", "item", 0.1), pairs.pearson(ratings, "user", "item", "stars"), cf.item_model(ratings)):
        plan = _plan(found)
        assert "hashpartitioning(a#" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(a#" in x and ", b#" in x]


def test_tasks_grow_with_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PAIRS", 100)
    rows, ratings = _ratings(spark)
    total = sum(v[0] for v in _by_hand(rows).values())
    assert pairs.pairs(ratings, "user", "item").rdd.getNumPartitions() == -(-total // 100)


def test_lsh_verifies_by_counts(spark):
    """Pairs that share a bucket and are similar, as candidates and their verification find them, without a join of candidates with items."""
    _, ratings = _ratings(spark)
    sigs = lsh.signatures(ratings, "user", "item", lsh.hash_family(6, 7), numbers=True)
    want = {tuple(r) for r in pairs.verify(lsh.candidates(lsh.bands(sigs, 1)), ratings, "user", "item", 0.2).collect()}
    found = lsh.similar(ratings, "user", "item", n_hashes=6, least=0.2, numbers=True)
    assert want and {tuple(r) for r in found.collect()} == want
    model = cf.user_model(ratings, n_hashes=6, jaccard=0.2, numbers=True)
    exact = {(r.a, r.b): (r.n, r.w) for r in cf.exact_user_model(ratings).collect()}
    assert {(r.a, r.b): (r.n, r.w) for r in model.collect()} == {k: v for k, v in exact.items() if k in {(a, b) for a, b, _ in want}}
    for df in (found, model):
        assert "band" not in _plan(df)


def test_bloom_looks_up_bits(spark):
    """A probe takes a step a position, not one for every bit that is set."""
    names = spark.range(3000).select(F.concat(F.lit("name "), "id").alias("s"), "id")
    bits = sketch.bloom_bits(names.where("id % 2 = 0"), "s")
    probed = sketch.bloom_probe(names, "s", bits)
    assert "array_except" not in _plan(probed)
    on = {r.position for r in bits.collect()}
    at = {r.id: set(r.p) for r in sketch.numbered(names, "s", sketch.NUMBERS).select("id", sketch.bloom_positions(F.col("__x")).alias("p")).collect()}
    assert {r.id: r.seen for r in probed.collect()} == {i: int(p <= on) for i, p in at.items()}
    assert all(r.seen == 0 for r in sketch.bloom_probe(names, "s", bits.limit(0)).collect())


def test_nearest_by_the_whole_distance(spark, monkeypatch):
    """Two labels whose distances differ in the ninth place only: the nearer one, not the lesser one."""
    points = spark.createDataFrame([(1, [0.0], 1)], "idx bigint, attrs array<double>, label int")
    monkeypatch.setattr(graphs, "_points", lambda spark, d: points)
    monkeypatch.setattr(graphs, "_means", lambda points: {1: ([1.000000002], [1.0]), 2: ([1.000000001], [1.0])})
    row = graphs.mahalanobis_nearest(spark, "").first()
    assert (row.idx, row.tag, row.distance) == (1, 2, 1.0)


def test_similarity_and_augmentation_by_classes(spark, monkeypatch):
    """Items of equal words are compared once, in lists of two, and give what all pairs of items give."""
    monkeypatch.setattr(hybrid, "CHUNK", 2)
    words = {i: ["a", "b", "c", "d"][: 4 - i % 2] if i < 12 else [f"w{i % 3}"] for i in range(20)}
    items = spark.createDataFrame([(i, w) for i, w in words.items()] + [(98, []), (99, [""])], "item bigint, words array<string>")
    sims = {(a, b): len({*words[a]} & {*words[b]}) / len({*words[a]} | {*words[b]}) for a, b in combinations(words, 2)}
    sims = {k: v for k, v in sims.items() if v >= 0.7}
    found = hybrid.category_similarity(items, "item", F.col("words"), 0.7)
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(sims) and {(a, b): s for a, b, s in rows} == sims and set(sims.values()) == {0.75, 1.0}
    _, ratings = _ratings(spark, users=12, items=20)
    averages = ratings.where("item % 5 > 0").groupBy("item").agg(F.avg("stars").alias("average"))
    classes = hybrid.category_classes(items, "item", F.col("words"))
    like = hybrid.class_similarity(classes, 0.7)
    assert like.count() == 1  # of the pairs of items, one of classes
    for nearest in (None, 2):
        got, want = ({(r.user, r.item): r.stars for r in hybrid.augment(ratings, s, averages, 3.0, below=9, least_similar=2, nearest=nearest, members=m).collect()} for s, m in ((like, classes), (found, None)))
        assert got and got == pytest.approx(want)


def test_models_leave_no_training_tables(spark, monkeypatch):
    """als_thresholds drops what each of its models was trained on before the next one is."""
    _, ratings = _ratings(spark, users=60, items=30)
    monkeypatch.setattr(recommend, "ratings", lambda spark, d: ratings)
    train, held = hybrid.train_als, []

    def spied(rows, *, keep, **o):
        held.append(len(keep))
        return train(rows, keep=keep, **o)

    monkeypatch.setattr(hybrid, "train_als", spied)
    assert recommend.als_thresholds(spark, "").count() == 4 and held == [0, 0, 0, 0]


def test_itemsets_grow_within_baskets(spark, monkeypatch):
    """Frequent sets by brute force, without candidates that no basket holds: here 60 pairs that share an item, and no third one."""
    rng = random.Random(5)
    baskets = [rng.sample(range(12), rng.randint(1, 6)) for _ in range(60)] + [[100, 101 + i % 20] for i in range(60)]
    rows = spark.createDataFrame([(b, i) for b, x in enumerate(baskets) for i in x], "basket bigint, item bigint")
    monkeypatch.setattr(itemsets, "extend", lambda level: pytest.fail("candidates are made"))
    want = {}
    for x in baskets:
        for n in range(1, len(x) + 1):
            for s in combinations(sorted(x), n):
                want[s] = want.get(s, 0) + 1
    want = {s: n for s, n in want.items() if n >= 3}
    assert max(map(len, want)) >= 3
    for found in (itemsets.frequent(rows, 3), itemsets.frequent_by_buckets(rows, 3)):
        assert {tuple(r["items"]): r.support for r in found.collect()} == want
