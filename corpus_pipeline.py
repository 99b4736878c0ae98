"""A corpus from documents to token ids: each stage works on all rows that the one before kept.

Rows are told apart by their id and the SHA-256 of their text, so that null and repeated ids do no harm; rows that repeat exactly share
every decision, and one of them stays after near-dedup. Null texts count as empty. All stages but the last keep every column of their
input, whatever its name: it travels as one struct. They give an empty table for an empty one; a very long text is handled whole, by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from tidemark.llm.common import remove, scratch, table


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): each row as one struct, and what stages go by."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "text")


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.struct(F.col("doc_id").alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("text"), F.col("text").isNull().alias("no_text"))
    return _packed(docs).withColumn("key", key)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are likelier toxic than not. Repeated rows and equal texts share a score; null and empty texts stay."""
    scored = toxicity.score_kept(_packed(docs), toxicity.fitted(spark, docs, sf_dir))
    return scored.filter(F.col("score") < 0.5).select("doc.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; documents that lose all of them stay, with an empty text. n_chars is counted anew. Ids that are no integers count as null."""
    kept = line_dedup.apply_keep_bitmaps(_packed(docs), line_dedup.line_keep_bitmaps(docs))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id (null before all), of equal ids that with the smallest hash of its text.

    Null, empty and blank texts are one group. Rows that repeat exactly differ in other columns at most; any one of them stays.
    """
    keyed = _keyed(docs)
    stay = simhash.near_duplicates(keyed, "key").filter("id = component_id").select(F.col("id").alias("key")).distinct()
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item. Repeated rows share the decision; null and empty texts stay."""
    keyed = _keyed(docs)
    found = decontaminate.contamination(keyed, table(spark, sf_dir, "benchmark"), "key").filter("n_hit > 0").select("key")
    return keyed.join(found, "key", "left_anti").select("doc.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its id, token ids, and digests of them and of the bytes that they stand for. Null texts are empty; other columns end here."""
    done = bpe.encode(docs, *bpe.default_tokenizer(), decoded=True)
    return done.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near dedup", near_copies), ("decontamination", benchmark), ("tokens", tokens)]

#: SQL expresses neither the classifier nor the fingerprints nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    at = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            remove(spark, f"{at}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
