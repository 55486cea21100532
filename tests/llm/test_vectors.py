import numpy as np

from ferrule.llm import common, vectors


def brute(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(ok)
    links = {i: set() for i, _ in rows}
    for a in ids:
        for b in ids:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def reach(links):
    out = {}
    for i in sorted(links):
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = i
                todo += links[x]
    return out


def make(n, seed, width=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, width))
    rows = []
    for i in range(n):
        x = base[rng.integers(0, 5) if rng.random() < 0.3 else rng.integers(0, len(base))]
        rows.append((i, (x + rng.standard_normal(width) * rng.choice([0, 0.1, 0.3, 0.35])).tolist()))
    return rows


def test_recall_and_precision(spark):
    rows = make(900, 1)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v, 1, True) for i, v in rows], "vec_id long, embedding array<float>, links int, kept boolean")).collect()}
    links = brute([(i, np.float32(v).tolist()) for i, v in rows])
    want = sum(map(len, links.values()))
    found = sum(r.n_links for r in got.values())
    assert 0.97 * want <= found <= want
    assert all(got[i].n_links <= len(links[i]) for i in links)
    parts = reach(links)
    assert sum(got[i].component_id == parts[i] for i in links) >= 0.97 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_small_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(make(300, 2), "vec_id long, embedding array<float>")
    one = sorted(vectors.near_duplicates(docs).collect())
    monkeypatch.setattr(vectors, "BLOCK", 7)
    assert sorted(vectors.near_duplicates(docs).collect()) == one


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [1.0, -0.0]), (9, [2.0, 0.0]), (10, [0.9, 0.43]), (11, [-1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, [1e300, 1e299]), (14, [1e-300, 1e-301])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (0, 5), 6: (0, 6), 7: (5, 7), 8: (5, 7), 9: (5, 7), 10: (5, 7), 11: (0, 11), 12: (0, 12), 13: (5, 7), 14: (5, 7)}


def test_null_and_repeated_ids(spark, monkeypatch):
    for hubs in (4096, 1):
        monkeypatch.setattr(common, "HUBS", hubs)
        rows = [(None, [1.0, 0.0]), (3, [1.0, 0.01]), (3, [0.0, 1.0]), (None, [-1.0, 0.0]), (None, [-1.0, 0.0]), (None, None), (2, [0.01, 1.0]), (5, [2.0, 0.0])]
        out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id, r.kept) for r in out.collect())
        assert got == [(-1, 0, -1, True), (-1, 1, -1, True), (-1, 1, -1, True), (-1, 2, 3, False), (2, 1, 2, True), (3, 1, 2, False), (3, 2, 3, True), (5, 2, 3, False)]


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
