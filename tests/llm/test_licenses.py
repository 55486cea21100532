import random
import re
import textwrap

import pytest

from ferrule.llm import licenses as L


def brute(rows, threshold=L.THRESHOLD):
    known = L.templates()
    hooks = set(L.hooks(known, threshold))
    found, in_units = {}, {}

    def hold(w):
        g = frozenset(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
        d, name = min((-2 * len(g & set(grams)) / (len(g) + len(grams)), name) for name, grams, *_ in known)
        return g, -d if -d >= threshold - 1e-12 else 0, name

    for i, text in rows:
        if text is None:
            continue
        t = text.lower()
        for u in set(re.split(r"[.!?][ \t\r]+|[\r\n]+", t)) | set(re.split(r"[\r\n]+", t)) | {t}:
            g, d, name = hold(L.normalise(u))
            if d:
                found.setdefault((i, name), set()).add(d)
                in_units.setdefault((i, name), set()).add(g)
        w, matched, top = L.normalise(t), [], {}
        for n, step in L.windows(known):
            if len(w) > n and hooks & set(w):
                for b in {*range(0, len(w) - n + 1, step), len(w) - n}:
                    if hooks & set(w[b : b + n]):
                        _, d, name = hold(w[b : b + n])
                        matched.append((b, n, d, name))
                        for p in range(b, b + n):
                            top[p] = max(d, top.get(p, 0))
        for b, n, d, name in matched:
            if d and all(top[p] <= d for p in range(b, b + n)):
                found.setdefault((i, name), set()).add(d)
    return {(i, n, round(max(s), 6), max(1, len(in_units.get((i, n), ())))) for (i, n), s in found.items()}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "; "])
def test_wrapped_notices(spark, mark):
    """Every template, wrapped at 75 columns behind comment marks, between other lines."""
    rows = []
    for i, (_, text) in enumerate(L.TEMPLATES):
        lines = textwrap.wrap("import this, then go on with that and more. " * (i % 2) + text, 75 - len(mark))
        rows.append((i, "\n".join(mark + x for x in ["Something else", *lines, "int main(void) and other words"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.doc_id, {})[r.license] = r.dice
    for i, (name, _) in enumerate(L.TEMPLATES):
        assert got[i].get(name, 0) >= 0.95, (name, got.get(i))


def test_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        _, text = rng.choice(L.TEMPLATES)
        w = text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1])] = [rng.choice(["foo", "Licence", "the", "é"])]
        noise = " ".join(rng.choices(["the", "under", "license", "version", "x", "of"], k=rng.randint(0, 30)))
        rows.append((i, rng.choice(["", noise + "\n", noise + ". "]) + rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", "\n" + noise, ". " + noise])))
    docs = spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id long, text string, license string, n int")
    got = {(r.doc_id, r.license, r.dice, r.n_units) for r in L.scan(docs).collect()}
    assert got == brute(rows)
    assert len(got) > 100


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n. "), (4, "x " * 200_000), (5, "Released under the MIT Licence."), (5, "released UNDER the MIT license!"), (None, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.license, r.dice, r.n_units) for r in L.scan(docs).collect())
    assert got == [(0, "CC-BY-NC-4.0", 1.0, 2), (5, "MIT", 1.0, 1)]
    assert L.scan(docs.limit(0)).count() == 0


def test_sql_twin(spark):
    import duckdb

    db = duckdb.connect()
    db.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = set(db.execute("SELECT doc_id, license, dice, n_units FROM (" + L.oracle_sql() + ")").fetchall())
    got = {(r.doc_id, r.license, r.dice, r.n_units) for r in L.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == want and got
