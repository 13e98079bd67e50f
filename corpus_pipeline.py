"""The corpus pipeline: documents are rejected, trimmed, deduplicated, decontaminated and mixed.

Every stage takes the documents its predecessor kept and all but the last return the columns of documents, so a stage
can be written as Parquet and reread as the next one's input. Of all stages: nulls in any column are allowed, texts are read
whole whatever their length, other columns of the input are dropped whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteq.llm import decontaminate, jaccard_join, line_dedup, mixing, quality
from siteq.llm.common import shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.7 or more.

    A null or empty text has the score of the share of good labels. Equal texts share a score, so repeated rows stay or go together.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share. One that held nothing else stays, with an empty text, and so does a null text.

    A line stays in the largest doc_id that holds it. Rows that share a doc_id are lines of one document, a row each.
    """
    return line_dedup.dedup_lines(docs, carry=("lang", "source")).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies (five-word shingles, similarity 0.8 or more).

    Rows that share a doc_id are one document and stay or go together, but of rows with equal doc_id and text one stays, which of them
    (by lang, source and n_chars, nulls first) is fixed. Rows without an id, a text or a word are in no group and stay.
    """
    groups = jaccard_join.jaccard_components(docs, n=5, num=4, den=5)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # repeated rows are found by hash and compared in full; only ids that come twice are looked at
    twice = kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    again = kept.where("text IS NOT NULL").join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("x"))
    again = again.select("doc_id", "text", "x.lang", "x.source", "x.n_chars")
    once = kept.join(twice.withColumn("again", F.lit(True)), "doc_id", "left").where(F.col("again").isNull() | F.col("text").isNull()).select(*COLUMNS)
    return once.unionByName(again.select(*COLUMNS))


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    All rows of a doc_id go when one of them holds an item; a row without an id goes by its own text.
    """
    some = docs.select(*COLUMNS)
    benchmark = table(spark, sf_dir, "benchmark")
    leaks = decontaminate.find_leaks(some, benchmark).select("doc_id").distinct()
    named = some.where("doc_id IS NOT NULL").join(leaks, "doc_id", "left_anti").select(*COLUMNS)
    # rows without an id are searched by the hash of their text
    bare = some.where("doc_id IS NULL").withColumn("place", F.xxhash64("text"))
    found = decontaminate.find_leaks(bare.select(F.col("place").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("place")).distinct()
    return named.unionByName(bare.join(found, "place", "left_anti").select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources takes, a row for each document.

    A null or empty text has none; a null source is a source; repeated rows count as often as they come.
    """
    return mixing.mix(docs)[0]


STAGES = [
    ("quality classifier", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", drop_test_items),
    ("mixing sources", mix_sources),
]

#: The first stage is a compression model, which SQL cannot express; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}-{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
