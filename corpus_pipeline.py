"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes what a stage returns to the shared folder and gives the next one what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.common import read, scratch, vocabulary
from duelframe.llm.jaccard import drop_near_duplicates
from duelframe.llm.kneser_ney import classify
from duelframe.llm.packing import pack_documents
from duelframe.llm.sentence_spans import drop_repeated_spans
from duelframe.llm.tiling import decontaminate


def by_row(docs: DataFrame, *others: DataFrame) -> tuple[DataFrame, ...]:
    """(docs with a column _key, others with their doc_id turned into keys): equal rows share a key, other rows don't.

    The key is doc_id where that tells rows apart. Where it doesn't, or is null, it is the id as text with two hashes of the row's
    columns; a row of others then counts only where its id has one text, as it doesn't say which of several it means. So what is decided
    for a text is done to that text alone.
    """
    n = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("different")).first()
    if n.rows == n.different:
        return docs.withColumn("_key", F.col("doc_id")), *others
    own = F.concat_ws("#", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.xxhash64(*docs.columns).cast("string"), F.xxhash64(F.lit(1), *docs.columns).cast("string"))
    rows = docs.withColumn("_key", own)
    keys = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("_key").alias("_key"), F.max("_key").alias("_last")).where("_key = _last").drop("_last")
    return rows, *(t.join(keys, "doc_id").drop("doc_id").withColumnRenamed("_key", "doc_id") for t in others)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    rows, labels = by_row(docs, read(spark, sf_dir, "labels"))
    found = classify(rows.select(F.col("_key").alias("doc_id"), "text", "lang"), labels)
    rejected = found.where("not keep").select(F.col("doc_id").alias("_key")).distinct()
    return rows.join(rejected, "_key", "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: the one with the smallest id."""
    return drop_near_duplicates(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentence runs that occur earlier; texts of which nothing is left go, n_chars follows the text."""
    cut = drop_repeated_spans(docs).where("n_removed = 0 or n_removed < n_sentences")
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold at least half of a benchmark item."""
    (rows,) = by_row(docs)
    found = decontaminate(rows, read(spark, sf_dir, "benchmark"), id_col="_key")
    return rows.join(found.where("contaminated").select("_key").distinct(), "_key", "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 4096 tokens."""
    return pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", sequences),
]

#: Not expressible: a fitted language model's thresholds, string tiling and a tokenizer's ids decide.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch(docs, f"stage{k}")
    return docs
