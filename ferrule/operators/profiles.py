"""Text profiles: the words of most weight a document, and similarity of users and documents by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import letter_words


def word_counts(texts: DataFrame, doc: str, text: str, stopwords: DataFrame | None = None) -> DataFrame:
    """(doc, word, n): additive, so documents of several texts need no concatenation."""
    words = texts.select(F.col(doc).alias("doc"), F.explode(letter_words(F.col(text))).alias("word"))
    counts = words.groupBy("doc", "word").agg(F.count("*").alias("n"))
    return counts.join(stopwords.select("word"), "word", "left_anti") if stopwords is not None else counts


def drop_rare_words(counts: DataFrame, share: float = 1e-6) -> DataFrame:
    """Without words whose total is at most `share` of all words, rounded down.

    Words are summed up before any is looked at, so the test runs over words, not over (document, word) pairs."""
    per_word = counts.groupBy("word").agg(F.sum("n").alias("total"))
    limit = counts.agg(F.floor(F.sum("n") * F.lit(share)).alias("limit"))
    kept = per_word.crossJoin(F.broadcast(limit)).where("total > limit").select("word")
    return counts.join(kept, "word", "left_semi")


def tfidf(counts: DataFrame, n_docs: int) -> DataFrame:
    """(doc, word, weight): count by the document's greatest count, times log2(documents / documents with the word)."""
    most = counts.groupBy("doc").agg(F.max("n").alias("most"))
    df = counts.groupBy("word").agg(F.count("*").alias("df"))
    weight = F.col("n") / F.col("most") * F.log2(F.lit(float(n_docs)) / F.col("df"))
    return counts.join(most, "doc").join(df, "word").select("doc", "word", weight.alias("weight"))


def top_words(weights: DataFrame, n: int = 200) -> DataFrame:
    """(doc, word, weight, rank) of each document's n weightiest words; ties in word order, weights compared at 9 places."""
    w = Window.partitionBy("doc").orderBy(F.desc(F.round("weight", 9)), "word")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def user_profiles(visits: DataFrame, profiles: DataFrame, user: str, doc: str) -> DataFrame:
    """(user, word): the union of the profiles of the documents that a user has."""
    return visits.select(F.col(user).alias("user"), F.col(doc).alias("doc")).distinct().join(profiles.select("doc", "word"), "doc").select("user", "word").distinct()


def score(pairs: DataFrame, users: DataFrame, profiles: DataFrame, least: float = 0.01) -> DataFrame:
    """(user, doc, sim): cosine of both boolean profiles, for wanted pairs of known users and documents."""
    nu = users.groupBy("user").agg(F.count("*").alias("nu"))
    nd = profiles.groupBy("doc").agg(F.count("*").alias("nd"))
    common = pairs.select("user", "doc").distinct().join(profiles.select("doc", "word"), "doc").join(users, ["user", "word"]).groupBy("user", "doc").agg(F.count("*").alias("n"))
    sim = F.col("n") / F.sqrt(F.col("nu") * F.col("nd"))
    return common.join(nu, "user").join(nd, "doc").select("user", "doc", sim.alias("sim")).where(F.col("sim") >= least)
