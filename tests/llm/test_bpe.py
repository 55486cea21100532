import hashlib

import public_tokenizers
import tiktoken

from ferrule.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, " ", "\n\n\t x", "Hello, wörld! 123 中文 é", "a" * 30_000, "'s 're don't", "\U0001f600 \x00 \x07", "the the the", "<unk><|endoftext|>", "一丁仿 ▁x"]


def test_matches_reference_library_and_round_trips(spark):
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        want = enc.encode_ordinary(t or "")
        assert list(got[i].ids) == want
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].decoded_ok


def test_documents(spark):
    ranks = bpe.load_ranks(PATH)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: enc.encode_ordinary(r.text or "") for r in docs.collect()}
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).count() == 0
