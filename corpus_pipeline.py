"""A training corpus from the documents table, in five stages.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; the driver writes it as Parquet and reads
it as the next stage's docs. All but the last return the columns of documents. Rows with null ids or texts pass like
any others (a null text is empty), and an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import exact_dedup, minhash, mixing, sentencepieces, toxicity
from lattica.llm.common import materialise, table

#: No stage but the second is expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the compression classifier predicts to be toxic."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the document with the largest id; of rows that repeat that id, too, one.

    Null texts equal the empty one; a null id is smaller than any. Rows that share an id but not the text stay apart.
    """
    verdicts = materialise(exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")))
    left = docs.withColumn("_own", F.sha2(F.coalesce("text", F.lit("")), 256))
    same = left["doc_id"].eqNullSafe(F.col("_id")) & (left["_own"] == F.col("_sha"))
    kept = left.join(verdicts.distinct(), same, "left_semi")
    again = verdicts.groupBy("_id", "_sha").count().where("count > 1")
    if not again.isEmpty():  # only rows of repeated ids are shuffled to tell them apart
        several = again.select("_id", "_sha")
        one = kept.join(several, same, "left_semi").dropDuplicates(["doc_id", "_own"])
        kept = kept.join(several, same, "left_anti").unionByName(one)
    return kept.drop("_own")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more on five-word shingles connect, keep the one with the smallest id.

    Null, empty and wordless texts link to nothing and stay. Rows that share an id stay or go each by its own text; a
    null id stays only where no linked document has an id.
    """
    verdicts = minhash.near_dedup(docs, width=5, percent=80).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    left = docs.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    return left.join(verdicts, left["doc_id"].eqNullSafe(F.col("_id")) & (left["_own"] == F.col("_key")), "left_semi").drop("_own")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take the documents that the sources' targets ask for; one that is taken k times is in the result k times.

    Rows that share an id, null ids too, are taken each by itself. Rows without words are in the result where the mix
    takes a copy of them; of an empty table nothing is.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers of every document under the SentencePiece model."""
    return sentencepieces.encode_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("MinHash near-dedup", drop_near_copies), ("source mixing", mix), ("SentencePiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
