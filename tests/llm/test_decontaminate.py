import random

import numpy as np

from ferrule.llm import decontaminate as D


def brute_lcs(item, text, weight):
    best = np.zeros((len(item) + 1, len(text) + 1))
    for i in range(len(item)):
        for j in range(len(text)):
            best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + weight[i] if item[i] == text[j] else 0)
    return best[-1, -1]


def test_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, text = rng.integers(0, 8, rng.integers(1, 12)), rng.integers(0, 8, rng.integers(0, 25))
        weight = rng.random(len(item))
        got, begin, end = D.common_subsequence(item, text, weight)
        assert abs(got - brute_lcs(item, text, weight)) < 1e-9
        assert abs(brute_lcs(item, text[begin:end], weight) - got) < 1e-9


def _corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of"] * 400
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 60))) + ("." if i % 2 else "")) for i in range(12)]
    docs, truth = [], set()
    for d in range(n):
        words = rng.choices(vocabulary, k=rng.randint(0, 400))
        if d % 3 == 0:
            i, text = rng.choice(items)
            w = text.replace(".", "").split()
            for _ in range(d // 3 % 3 * len(w) // 20):  # 0, 5 or 10 % of the words
                k = rng.randrange(len(w))
                what = rng.random()
                if what < 0.4:
                    w[k] = rng.choice(vocabulary)
                elif what < 0.7:
                    del w[k]
                else:
                    w.insert(k, rng.choice(vocabulary))
            at = rng.randint(0, len(words))
            words[at:at] = [x.upper() if d % 2 else x for x in w]
            truth.add((d, i))
        docs.append((d, " ".join(words)))
    return docs, items, truth


def test_finds_copies_and_paraphrases_only(spark, monkeypatch):
    docs, items, truth = _corpus(1)
    d = spark.createDataFrame([(i, t, "c", 0) for i, t in docs], "doc_id long, text string, cosine string, item_id int").repartition(12)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in D.find(d, b).collect()}
    assert got.keys() == truth
    words = dict(docs)
    for (i, k), r in got.items():
        inside = words[i][r.begin : r.end].lower().split()
        assert len(set(inside) & set(dict(items)[k].replace(".", "").split())) > 0.5 * len(set(inside)) and r.share > 0.6
    monkeypatch.setattr(D, "BATCH", 5)
    assert {(r.doc_id, r.item_id) for r in D.find(d, b).collect()} == truth


def test_batches_change_nothing(spark, monkeypatch):
    """Items with 20 to 40 % of their words changed, in batches of any size; and the search against every place, in plain Python."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of"] * 400
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(15, 50)))) for i in range(25)]
    docs = []
    for d in range(300):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        w = rng.choice(items)[1].split()
        for k in rng.sample(range(len(w)), int(len(w) * rng.uniform(0.2, 0.4))):
            w[k] = rng.choice(vocabulary)
        at = rng.randint(0, len(words))
        words[at:at] = w
        docs.append((d, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes = {}
    for size in (256, 8, 2):
        monkeypatch.setattr(D, "BATCH", size)
        sizes[size] = {(r.doc_id, r.item_id) for r in D.find(frame, bench).collect()}
    assert sizes[256] == sizes[8] == sizes[2]
    # blocks of 16 words, of each document from its first word on
    blocks = [t.split()[a : a + D.BLOCK] for _, t in docs for a in range(0, len(t.split()), D.BLOCK)]
    of = {}
    for b in blocks:
        for w in set(b):
            of[w] = of.get(w, 0) + 1
    idf = lambda w: max(1e-3, np.log((len(blocks) + 1) / (of.get(w, 0) + 0.5)))
    want = set()
    for d, text in docs:
        words = text.split()
        for i, t in items:
            item = t.split()
            weight, span = np.array([idf(w) for w in item]), 2 * len(item) + 2 * D.BLOCK
            if sum(w for w, x in zip(weight, item, strict=True) if x in set(words)) < D.SHARE * weight.sum():
                continue
            if any(D.common_subsequence(np.array(item), np.array(words[a : a + span]), weight)[0] >= D.SHARE * weight.sum() + 1e-4 for a in range(0, len(words), 4)):
                want.add((d, i))
    assert len(want) > 100 and len(want - sizes[256]) == 0
    assert len(sizes[256] - want) <= 0.02 * len(want)


def test_long_items_make_pieces():
    text = " ".join(f"w{i}" for i in range(300))
    got = D.pieces(text + " .", D.W.Powers())
    assert " ".join(got) == text and [len(p.split()) for p in got] == [60] * 5 and D.pieces(" . ", D.W.Powers()) == []


def test_answers(spark):
    docs, items, _ = _corpus(2, 60)
    question = dict(items)[0].replace(".", "").split()
    half = " ".join(question[: len(question) // 2 + 1])
    d = spark.createDataFrame([*docs, (900, "x1 x2 " + half + " x3 x4"), (901, "x1 x2 " + half + " blue whale x4")], "doc_id long, text string")
    b = spark.createDataFrame([(0, dict(items)[0], "Blue whale.")], "item_id long, text string, answer string")
    ids = {r.doc_id for r in D.find(d, b, answer_col="answer").collect()}
    assert 901 in ids and 900 not in ids


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta gamma delta epsilon"), (3, " .. "), (4, "Alpha, BETA; gamma\ndelta epsilon"), (4, "alpha beta gamma delta epsilon"), (5, "é " * 60_000)]
    items = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, "..."), (None, "alpha beta"), (5, "z " * 700)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in D.find(d, b).collect()) == [(0, 1), (4, 1), (4, 1)]
    assert D.find(d.limit(0), b).count() == 0
    assert D.find(d, b.limit(0)).count() == 0


def test_paraphrases_of_widely_copied_items(spark):
    rng = random.Random(7)
    items = [(i, [f"i{i}w{k}" for k in range(30)]) for i in range(6)]
    filler = [f"f{k}" for k in range(3000)]
    docs = []
    for i, words in items:
        docs += [" ".join(rng.choices(filler, k=20) + words) for _ in range(14)]  # so often that only an item's RAREST words are searched
        docs += [" ".join(rng.choices(filler, k=20) + words[8:] + rng.choices(filler, k=20)) for _ in range(4)]  # the first eight are the rarest
        for share in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6) * 5:
            # the rarest words change more often
            changed = [rng.choice(filler) if rng.random() < (2 * share if k < 8 else share) else w for k, w in enumerate(words)]
            docs.append(" ".join(rng.choices(filler, k=rng.randint(0, 20)) + changed + rng.choices(filler, k=rng.randint(0, 20))))
    docs += [" ".join(rng.choices(filler, k=60)) for _ in range(40)]
    blocks = [set(t.split()[a : a + D.BLOCK]) for t in docs for a in range(0, len(t.split()), D.BLOCK)]
    truth, exhaustive = set(), {}
    for i, words in items:
        idf = np.array([np.log((len(blocks) + 1) / (sum(w in b for b in blocks) + 0.5)) for w in words])
        for d, text in enumerate(docs):
            t = text.split()
            got = sum(v for w, v in zip(words, idf, strict=True) if w in t)  # words keep their order here, and none is repeated
            exhaustive[d, i] = got / idf.sum()
            if exhaustive[d, i] >= D.SHARE:
                truth.add((d, i))
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.share for r in D.find(d, b).collect()}
    assert truth == got.keys() and len(truth) > 150
    assert all(abs(v - exhaustive[k]) < 1e-4 for k, v in got.items())
