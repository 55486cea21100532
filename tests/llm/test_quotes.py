import random

import duckdb
import pyarrow as pa

from ferrule.llm import quotes


def compare(spark, rows):
    table = pa.table({"conv_id": pa.array([r[0] for r in rows], pa.int64()), "turn": pa.array([r[1] for r in rows], pa.int64()), "role": pa.array([r[2] for r in rows], pa.string()), "text": pa.array([r[3] for r in rows], pa.string())})
    db = duckdb.connect()
    db.register("conversations", table)
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as root", "1 as lines")).collect()
    names = list(got[0].asDict()) if got else ["conv_id", "turn"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({quotes.oracle_sql()})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return {(r.conv_id, r.turn): r for r in got}


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nI tried bubble sort."),
        (1, 1, "a", "> How do I sort?\n\nUse sorted()."),
        (1, 2, "b", "Ann wrote:\n> I tried BUBBLE   sort!\n\nDon't."),
        (1, 3, "user", "On Monday, a wrote:\n>> How do I sort?\n> Use sorted().\n\nThanks.\n"),
        (1, 5, "b", ">> Use sorted().\n> Thanks.\n> no one said this\nYou're welcome.\nHe wrote:\nthe end"),
        (2, 7, None, None),
        (2, 9, "user", "> Thanks.\nother conversation"),
    ]
    got = compare(spark, rows)
    assert [got[k].reply_to for k in sorted(got)] == [None, 0, 0, 1, 3, None, 7]
    assert got[1, 3].text == "Thanks." and got[1, 3].n_quoted == 2 and got[1, 5].depth == 3 and got[1, 5].position == 4
    assert got[1, 5].text == "You're welcome.\nHe wrote:\nthe end" and not got[2, 9].by_quote


def test_random_conversations(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BUCKET", 4)
    rng = random.Random(1)
    vocabulary = ["yes", "no", "thanks", "ok then", "what now", "é", "see you", "stop"]
    rows = []
    for c in range(12):
        texts = []
        for t in range(rng.choice([1, 3, 8, 40])):
            parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 3))]
            if texts and rng.random() < 0.7:
                quoted = ["> " * rng.randint(0, 1) + "> " + x for x in rng.choice(texts).split("\n")]
                parts = ["X wrote:"] * rng.randint(0, 1) + quoted + parts
            texts.append("\n".join(parts))
            rows.append((c, t * rng.randint(1, 3) + t * 3, rng.choice(["user", "assistant"]), texts[-1]))
    compare(spark, rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "x"), (1, None, "u", "x"), (1, 1, "u", "b"), (1, 1, "u", "a"), (1, 1, None, "c"), (1, 2, "u", "> c"), (2, 1, "u", ""), (2, 2, "u", None), (3, 0, "u", "> " * 40_000)]
    got = compare(spark, rows)
    assert got[1, 1].text == "c" and got[1, 2].by_quote
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link(empty).count() == 0
