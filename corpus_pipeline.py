"""A corpus from raw documents to packed token sequences, stage by stage.

All stages take nulls in any column, empty and very long texts, empty tables and further columns. All but
the last return the columns of their input. A row with a null doc_id is judged by its text like any other in
the filters; near-dedup keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, langid, packing, pii, simhash
from cadenza.llm.common import KeySet, new_folder, small_batches, stored
from cadenza.llm.queries import pii_key, tokenizer_file

#: Near copies share 0.8 of the five-word shingles of both. Their 256-bit SimHash differs in about 39 bits then (acos(2 * 0.8 / 1.8)),
#: that of unrelated texts in about 128; the index takes as candidates what differs in at most so many bits of the first 64, 128, 192 and 256.
#: That leaves out some 2 of 10,000 pairs at just 0.8, and links a text with 2 * 10^-6 of 10^11 unrelated ones.
NEAR_LEAST, NEAR_BITS = 0.8, (22, 36, 49, 62)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model tells better than by chance: with a tenth more than an equal share of probability.

    The scores are calibrated, so a short clean text among numbers may well have a low one; only what the model can't tell at all goes.
    A text that is null or has no letter is rejected. Without any labelled text to learn from, nothing is.
    """
    small_batches(spark)
    model = langid.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return langid.keep_known(docs, model, min(1.0, 1.1 / len(model.languages))) if model.languages else docs


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of the five-word shingles of 0.8, exactly checked) keep one document, that with the smallest id.

    Rows of equal id and text are one document and are kept once. Other columns may have any names.
    """
    small_batches(spark)
    names = docs.columns
    doc_id, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    docs = docs.toDF(*(f"c{k}" for k in range(len(names))))
    key = F.struct(doc_id, F.xxhash64(text))
    again = stored(docs.groupBy(key.alias("_again")).count().where("count > 1").select("_again"), "documents-again")
    if not again.isEmpty():
        own = key == F.col("_again")
        docs = stored(docs.join(again, own, "left_anti").unionByName(docs.join(again, own, "left_semi").dropDuplicates([doc_id, text])), "documents-once")
    found = simhash.near_copies(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), 5, NEAR_LEAST, NEAR_BITS)
    gone = stored(found.select(simhash.row_key(F.col("doc_id"), F.col("h")).alias("key")), "near-copies")
    keys = KeySet.of(gone, "near-copies-keys", gone.count(), file_rows=250_000)
    return docs.where(~keys.having(simhash.row_key(F.col(doc_id).cast("long"), F.xxhash64(text)))).toDF(*names)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    small_batches(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal numbers, dates and addresses by pseudonyms."""
    return pii.pseudonymise(docs, pii_key(spark))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 4096. Tasks keep fewer words than by default: after the other stages executors have less memory to spare."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_file(), 4096, 2, most_words=200_000)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL has a tokenizer, SimHash or a trained classifier; tests compare with brute-force versions.
ORACLE_SQL = None
