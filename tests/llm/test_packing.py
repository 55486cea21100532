import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ferrule.llm import bpe, packing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def slow_best_fit(lengths, most):
    bins = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = [(most - sum(lengths[j] for j in b), k) for k, b in enumerate(bins)]
        room = [x for x in room if x[0] >= lengths[item]]
        if room:
            bins[min(room)[1]].append(item)
        else:
            bins.append([item])
    return bins


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(100):
        most = rng.randint(2, 50)
        lengths = [rng.randint(1, most) for _ in range(rng.randint(0, 80))]
        got, want = packing.best_fit_decreasing(lengths, most), slow_best_fit(lengths, most)
        # which of several rows with equal room is taken is free; how full rows are isn't
        assert sorted(sum(lengths[i] for i in b) for b in got) == sorted(sum(lengths[i] for i in b) for b in want)
        assert sorted(i for b in got for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= most for b in got)


@pytest.mark.parametrize("length", [16, 512])
def test_round_trip(spark, length, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 20_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(9000, None), (9001, ""), (9002, "a " * 9000), (9003, "same"), (9004, "same")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(extra).selectExpr("*", "1 as row", "'x' as ids").repartition(3)
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = packing.pack(docs, PATH, public_tokenizers.PATTERN, length=length).collect()
    parts = {}
    for r in rows:
        assert len(r.ids) == 2 * length and r.cu_seqlens[-1] == r.n_tokens <= length and r.resets == r.cu_seqlens[:-1]
        assert (np.frombuffer(r.ids, "<u2")[r.n_tokens :] == len(ranks)).all()
        pos = packing.position_ids(r.cu_seqlens)
        assert np.flatnonzero(pos == 0).tolist() == r.resets and len(pos) == r.n_tokens
        for d, s, ids in packing.unpack(r):
            parts.setdefault(d, []).append((s, ids.tolist()))
    assert len({(r.split, r.stretch, r.row) for r in rows}) == len(rows)
    want = {r.doc_id: [*enc.encode_ordinary(r.text or ""), len(ranks)] for r in docs.collect()}
    assert {d: sum((ids for _, ids in sorted(p)), []) for d, p in parts.items()} == want
    filled = sum(r.n_tokens for r in rows) / (length * len(rows))
    assert filled > 0.95


def test_null_id_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c")], "doc_id long, text string")
    assert sorted(str(d) for r in packing.pack(docs, PATH, public_tokenizers.PATTERN).collect() for d in r.doc_ids) == ["1", "None"]
    assert packing.pack(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
