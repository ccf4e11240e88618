"""Keyword, vector and fused document search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import cosine
from ..functions.numbering import ensure_checkpoints

#: Usual constants of the Okapi weighting.
K1, B = 1.2, 0.75


def _top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def bm25_scores(documents: DataFrame, query: str, key: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    """(key, score) of documents that hold a query word.

    Texts are cut into words once: the word counts of each document, a few
    numbers a row, are checkpointed. Document frequencies and the mean length
    are one small aggregation over them, before ``where`` applies, and so are
    the scores.
    """
    words = sorted({w for w in _query_words(query)})
    zero = F.lit(0.0)
    if not words:
        return documents.select(key, zero.alias("score")).where(F.lit(False))
    keep = F.lit(True) if where is None else where
    listed = documents.select(key, keep.alias("__keep"), F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+").alias("__t"))
    ends = F.when(F.element_at("__t", 1) == "", 1).otherwise(0) + F.when((F.size("__t") > 1) & (F.element_at("__t", -1) == ""), 1).otherwise(0)  # empty words stand at the ends alone
    ensure_checkpoints(documents.sparkSession)
    slim = listed.select(key, "__keep", (F.size("__t") - ends).alias("__n"), *[(F.size("__t") - F.size(F.array_remove("__t", w))).alias(f"__tf{i}") for i, w in enumerate(words)]).checkpoint()
    stats = slim.agg(F.count("*").alias("__all"), F.avg("__n").alias("__avg"), *[F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(words))])
    score = zero
    for i in range(len(words)):
        tf, df = F.col(f"__tf{i}"), F.col(f"__df{i}")
        idf = F.log(1 + (F.col("__all") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__n") / F.col("__avg")))
    found = F.greatest(*[F.col(f"__tf{i}") for i in range(len(words))], F.lit(0)) > 0
    return slim.where(F.col("__keep") & found).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # one row


def _query_words(query: str) -> list[str]:
    import re

    return [w for w in re.split("[^a-z0-9]+", query.lower()) if w]


def keyword_search(documents: DataFrame, query: str, k: int = 5, key: str = "doc_id", text: str = "text", where: Column | None = None) -> DataFrame:
    return _top(bm25_scores(documents, query, key, text, where).withColumn("score", F.round("score", 6)), "score", key, k)


def vector_scores(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) by cosine; vectors without a cosine are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vector), q).alias("score")).where(F.col("score").isNotNull())


def vector_search(vectors: DataFrame, query: list[float], k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The nearest with score, distance (1 - cosine) and certainty (1 - distance / 2)."""
    got = vector_scores(vectors, query, key, vector).withColumn("score", F.round("score", 6))
    return _top(got, "score", key, k).withColumn("distance", F.round(1 - F.col("score"), 6)).withColumn("certainty", F.round(1 - (1 - F.col("score")) / 2, 6))


def _normal(scores: DataFrame, name: str) -> DataFrame:
    """Scores moved and scaled to 0..1; all equal scores become 1."""
    ends = scores.agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return scores.crossJoin(F.broadcast(ends)).select("key", F.when(span > 0, (F.col("score") - F.col("__lo")) / span).otherwise(1.0).alias(name))  # one row


def fused_search(documents: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], alpha: float = 0.5, k: int = 5, where: Column | None = None) -> DataFrame:
    """``alpha`` times the vector score plus the rest of the keyword score, each scaled to 0..1.

    A document without one of the scores has 0 for it. The filter applies
    before scaling; word statistics are those of the whole corpus.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    words = bm25_scores(documents, query, where=where).withColumnRenamed("doc_id", "key")
    near = vector_scores(vectors, query_vector).withColumnRenamed("vec_id", "key")
    kept = documents if where is None else documents.where(where)
    near = near.join(kept.select(F.col("doc_id").alias("key")), "key", "left_semi").checkpoint()  # read for its ends and for the scores
    both = _normal(words, "w").join(_normal(near, "v"), "key", "full_outer")
    score = F.round(F.lit(alpha) * F.coalesce("v", F.lit(0.0)) + F.lit(1 - alpha) * F.coalesce("w", F.lit(0.0)), 6)
    return _top(both.select(F.col("key").alias("doc_id"), score.alias("score")), "score", "doc_id", k)


def compare_methods(documents: DataFrame, vectors: DataFrame, query: str, query_vector: list[float], k: int = 5) -> DataFrame:
    """(method, doc_id, score) of keyword, vector and two fused searches."""
    found = {
        "keyword": keyword_search(documents, query, k),
        "vector": vector_search(vectors, query_vector, k).select(F.col("vec_id").alias("doc_id"), "score"),
        "fused_05": fused_search(documents, vectors, query, query_vector, 0.5, k),
        "fused_07": fused_search(documents, vectors, query, query_vector, 0.7, k),
    }
    out = None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("method"), "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
