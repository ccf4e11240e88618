"""A training corpus in five stages: rules, near duplicates, substrings, secrets, packing.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and read again as the next stage's documents; all stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import jaccard, packing, quality, secrets, substrings
from tessel.llm.common import prepare, read, stored
from tessel.llm.queries import tokenizer_file

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rule or the learned decision list rejects.

    A null or empty text has no words and is dropped; repeated rows and ties are
    judged alike; a null doc_id is judged like others; no documents give no
    rows; further columns are dropped.
    """
    prepare(spark)
    rules = quality.learn_from(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of similar documents: the smallest id, and of repeated ids the smallest text hash.

    Null ids count as larger than others; repeated rows are kept once; documents
    without words are in no group and stay; no documents give no rows; further
    columns are dropped.
    """
    prepare(spark)
    groups, _ = jaccard.similar_groups(docs)
    rows = groups.groupBy("doc_id", "text_hash", "component_key").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "times")).alias("first")
    kept = rows.where("component_key is not null").groupBy("component_key").agg(first).select("first.*")
    kept = stored(kept.select("doc_id", "text_hash", "times").union(rows.where("component_key is null").select("doc_id", "text_hash", F.lit(1).alias("times"))))
    kept = kept.withColumnsRenamed({"doc_id": "__doc", "text_hash": "__hash"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash"))
    found = docs.select(*COLUMNS)
    if kept.where("times > 1").isEmpty():
        return found.join(kept, same, "left_semi")
    once = found.join(kept.where("times > 1"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return found.join(kept.where("times = 1"), same, "left_semi").union(once)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller id holds; documents that lose nothing keep their text as it is.

    Null and empty texts stay as they are; a null doc_id loses nothing and is no
    source; rows with equal ids do not count against each other; no documents
    give no rows; further columns are dropped.
    """
    prepare(spark)
    out = substrings.deduplicate(docs, keep_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind in brackets.

    A null text becomes an empty one; texts of any length are scanned whole;
    repeated rows share one scan; no documents give no rows; further columns
    are dropped.
    """
    prepare(spark)
    out, _ = secrets.scan(docs)
    clean = secrets.redacted(F.col("text"), F.col("found"))
    hit = F.size("found") > 0
    return out.withColumn("text", clean).withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the corpus into sequences of 4096 tokens.

    Null and empty texts are an end id alone; repeated rows are packed as often
    as they occur; ties go by doc_id, then piece; no documents give no pieces;
    further columns are ignored.
    """
    prepare(spark)
    return packing.pack(packing.pieces(docs, tokenizer_file("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Learned rules and similarity groups have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
