import random
import zlib

import numpy as np
import pyarrow as pa

from ferrule.llm import toxicity
from ferrule.llm import words as W

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [(truth[r.doc_id], r.predicted, r.doc_id) for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(t and p for t, p, _ in test)
    toxic, said = sum(t for t, _, _ in test), sum(p for _, p, _ in test)
    print("recall", hit / toxic, "precision", hit / max(1, said), toxic)
    assert hit / toxic >= 0.9 and hit / said >= 0.9  # about 300 toxic documents to learn from; with 1,400 it finds all


def _texts(seed, n):
    rng = random.Random(seed)
    syllables = ["ra", "ne", "to", "li", "mu", "sha", "vor", "ken", "dip", "ost"]
    out = []
    for i in range(n):
        w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 200))]
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "numbskull", "nitwitted"]))
        out.append((" ".join(w), int(i % 3 == 0)))
    return out


def test_unseen_misspellings():
    model = toxicity.train(*map(list, zip(*_texts(1, 900), strict=True)))
    column = pa.array(["ra ne to blokhead li mu", "ra ne numbskulls to", "rane nitwited to li", "ra ne to li mu sha vor"], pa.large_string())
    s = model.scores(column, W.Powers())
    assert (s[:3] > 0.7).all() and s[3] < 0.3


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_SAMPLE", 3)
    monkeypatch.setattr(toxicity, "CLEAN_SAMPLE", 4)
    monkeypatch.setattr(toxicity, "LONGEST", 50)
    docs = spark.createDataFrame([(i, f"text {i} {j}" + " long" * 20 * (i % 5 == 0)) for i in range(40) for j in range(6)], "doc_id long, text string")
    rows = toxicity.sample(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")).collect()
    assert sorted(r.y for r in rows) == [0] * 4 + [1] * 3
    assert all(len(r.text) <= 50 and r.text == f"text {r.id} 0" and zlib.crc32(str(r.id).encode()) % 3 != 1 for r in rows)


def test_bags_equal_brute_force(spark):
    """Scores of a trained model, against means of the highest words' n-gram values in plain Python."""
    texts, labels = map(list, zip(*_texts(2, 200), strict=True))
    model = toxicity.train(texts, labels)
    values = [model.scores(pa.array([t], pa.large_string()), W.Powers())[0] for t in texts[:40]]
    for text, got in zip(texts[:40], values, strict=True):
        means = []
        for word in text.lower().split():
            raw = np.frombuffer(word.encode(), np.uint8)
            grams, _ = toxicity.bags(raw, np.array([0]), np.array([len(raw)]), W.Powers())
            assert len(grams) == sum(max(0, len(raw) + 2 - n + 1) for n in toxicity.GRAMS)
            means.append(model.table[grams].astype(float).mean())
        best = [x for x in sorted(means)[-toxicity.BAG :] if x > 0] or [max(means)]
        want = 1 / (1 + np.exp(-(model.slope * sum(best) / toxicity.BAG + model.shift)))
        assert abs(got - want) < 1e-6


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, " .. ", 9.0), (None, "a b", 9.0), (4, "x " * 100_000, 9.0), (4, "idiot", 9.0)], "doc_id long, text string, score double")
    for labels in ([(1, 1), (2, None), (3, 7)], [], [(4, 1), (5, 0), (None, 1)]):
        got = toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.classify(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    kept = toxicity.classify(docs, spark.createDataFrame([], "doc_id long, toxic int"), keep=True)
    assert kept.columns == ["doc_id", "text", "held_out", "score", "predicted"]
