"""The corpus pipeline: filter, clean, deduplicate, decontaminate and pack ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes each result as Parquet
in the cluster's shared folder and reads it again as the next stage's documents; all stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starledger.llm import decontam, jaccard, line_dedup, packing, toxicity
from starledger.llm.common import broadcast_if_small, checkpointed, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can express neither the trained classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    lexicon, model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs.select(*COLUMNS), lexicon, model).where("score < 0.5").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their sources' boilerplate lines; ``n_chars`` follows the text.

    A group of near copies counts as one page, so that its own lines aren't boilerplate.
    """
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS), groups=line_dedup.near_copy_groups(docs))
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies: that of the smallest id, and among these of the smallest hash of its text.

    Rows go by id and text, so ids may repeat; of rows that repeat both, one stays. A row without an id
    stays only where its component has none with one. Rows without words are in no component and all stay.
    """
    rows = jaccard.near_classes(docs).where("class is not null").groupBy("class", "doc_id", "text_key").agg(F.count("*").alias("met"))
    pairs = checkpointed(rows)
    # One row for each group, sent to all workers if they are few; checkpointed, so that adaptive execution can split a hot class of the join otherwise.
    best = checkpointed(pairs.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lone"), "doc_id", "text_key")).alias("best"), F.sum("met").alias("size")).where("size > 1"))
    placed = checkpointed(pairs.join(broadcast_if_small(best, best.count(), jaccard.BROADCAST_ROWS), "class").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"), "met", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))).alias("stays")))
    dropped, repeated = placed.where("not stays").select("_id", "_text"), placed.where("stays and met > 1").select("_id", "_text")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))

    def side(keys: DataFrame, count: int) -> DataFrame:
        return broadcast_if_small(keys, count, jaccard.BROADCAST_ROWS)

    left = docs.select(*COLUMNS).join(side(dropped, dropped.count()), same, "left_anti")
    again = repeated.count()
    if not again:
        return left
    once = left.join(side(repeated, again), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(side(repeated, again), same, "left_anti").unionByName(once)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard_join", keep_one_of_group),
    ("benchmark_decontamination", decontaminate),
    ("packing", pack),
]


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written below the cluster's shared folder and removed when the next one is done.

    The last stage's files are what the result reads; they are the caller's to remove.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _remove(spark, before)
        before = f"{folder}/{name}"
    return docs
