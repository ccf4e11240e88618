"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import disclosure, extraction, jaccard, language, neighbours, packing, pieces, quality, secrets, substrings
from .common import prepare, read, shared_dir
from .oracles import ORACLE_SQL
from .spans import count_of, ordered, written

__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_file"]


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed as repeated passages, and a digest of the words kept."""
    prepare(spark)
    out = substrings.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: text, declared language and source as host."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("host"), F.lit(None).cast("string").alias("suffix"), F.col("lang").alias("declared"))
    return language.identify(rows).withColumnRenamed("id", "doc_id")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page: text, the lang of its html tag, the suffix of its address and its host."""
    prepare(spark)
    return language.identify(language.of_pages(read(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms near it that reveal it."""
    prepare(spark)
    out = disclosure.protect(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in disclosure.BASE],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(ordered(F.col("base"), F.col("terms"))).alias("spans"),
    )


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by way of a ledger table of this run."""
    prepare(spark)
    ledger = f"{shared_dir(spark)}/tessel/ledger-{uuid.uuid4().hex}"
    out = secrets.scan_with(read(spark, sf_dir, "documents").select("doc_id", "text"), ledger)
    base = secrets.base_of(F.col("found"))
    return out.select(
        "doc_id",
        *[count_of(F.col("found"), k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and the component it falls in."""
    prepare(spark)
    out, _ = jaccard.similar_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id")


def op6_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    prepare(spark)
    out = extraction.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    prepare(spark)
    rows = read(spark, sf_dir, "embeddings")
    out, _ = neighbours.search(rows, rows.where(F.col("vec_id") % 20 == 0))
    return out


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    prepare(spark)
    model = tokenizer_file("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.recode(docs, model)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and place; nulls count as empty, repeated rows are packed as often, no documents give no rows."""
    prepare(spark)
    return packing.pack(packing.pieces(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document; a null text has no words and fails, repeated rows are judged alike, no documents give no rows."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    rules = quality.learn_from(docs, read(spark, sf_dir, "labels"))
    out = quality.judge(docs, rules, ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language_id": op2_language_id,
    "language_of_pages": language_of_pages,
    "op3_disclosure": op3_disclosure,
    "op4_secret_ledger": op4_secret_ledger,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_template_extraction": op6_template_extraction,
    "op7_learned_partitions": op7_learned_partitions,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_quality_rules": op10_quality_rules,
}