"""Registry of the queries of this subpackage and of their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.llm import bpe, decontaminate, html, jaccard, licenses, packing, quotes, substring, toxicity, vectors
from ferrule.llm.common import read


def op1_byte_bpe(spark, d):
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers

    out = bpe.encode(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_html_templates(spark, d):
    """Main text of every page."""
    return html.extract(read(spark, d, "pages"))


def op3_subword_toxicity(spark, d):
    """Toxicity score of every document."""
    return toxicity.classify(read(spark, d, "documents"), read(spark, d, "labels"))


def op4_collision_projections(spark, d):
    """Links and class of every embedding."""
    return vectors.near_duplicates(read(spark, d, "embeddings"))


def op5_line_dedup(spark, d):
    """Every document's text without passages that stand in an earlier place, and their spans."""
    return substring.remove(read(spark, d, "documents")).select("doc_id", "text", "removed")


def op6_packed_tokens(spark, d):
    """All documents' token ids in rows of 2048, written, and what each row holds."""
    import public_tokenizers

    path = packing.write(packing.pack(read(spark, d, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    rows = spark.read.parquet(path)
    return rows.select("split", "stretch", "row", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "cu_seqlens", "resets", "doc_ids", "starts")


def op7_quotation_linking(spark, d):
    """Messages without quotes, tied to the messages that they answer."""
    return quotes.link(read(spark, d, "conversations"))


def op8_latent_decontamination(spark, d):
    """Which documents hold which items of the benchmark, and where."""
    return decontaminate.find(read(spark, d, "documents"), read(spark, d, "benchmark"))


def op9_ngram_jaccard(spark, d):
    """Size of each document's shingle set and its class of similar documents."""
    return jaccard.join(read(spark, d, "documents")).drop("first")


def op10_license_dice(spark, d):
    """The licences that each document states."""
    return licenses.scan(read(spark, d, "documents"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_templates": op2_html_templates,
    "op3_subword_toxicity": op3_subword_toxicity,
    "op4_collision_projections": op4_collision_projections,
    "op5_line_dedup": op5_line_dedup,
    "op6_packed_tokens": op6_packed_tokens,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_latent_decontamination": op8_latent_decontamination,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_license_dice": op10_license_dice,
}
SQL: dict[str, str] = {"op7_quotation_linking": quotes.oracle_sql(), "op9_ngram_jaccard": jaccard.oracle_sql(), "op10_license_dice": licenses.oracle_sql()}


def pipeline(spark, d):
    """The stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict:
    return QUERIES | {"pipeline": pipeline}


def oracle_sql() -> dict:
    return dict(SQL)
