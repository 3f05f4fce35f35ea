"""A corpus pipeline: STAGES, each on what its predecessor kept, from `documents` to packed bins.

Of all stages: extra columns of `documents` (whatever their names) are left behind; an empty table passes as an empty table;
texts of any length are read whole; reruns agree. What a stage does with nulls, empty texts, ties and repeated rows is said
below. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import cut, fold, shared_dir, small
from waymark.llm.language_id import fit_languages, identify_languages
from waymark.llm.mixing import mixed_documents
from waymark.llm.packing import pack
from waymark.llm.quality_cnn import fit_quality, score_quality
from waymark.llm.setsketch import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. The model learns from the stage's own rows, as op7 does. Null, empty and
    letterless texts go, as undetermined ones, and those whose best two languages are too close; repeated rows and rows
    with a null id are judged each by its text. Without a labelled row outside the held-out fold nothing is recognised."""
    model = fit_languages(docs.where(fold(F.col("doc_id"), 5) != 0))
    return identify_languages(docs, model, keep=("text", "lang", "source", "n_chars")).where(~F.col("rejected")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be of quality 1. Null and empty texts score 0 and go; repeated rows and rows with a null id
    are judged each by its text; null labels, and labels of unknown ids, are passed over."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = fit_quality(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return score_quality(docs, net, keep=("text", "lang", "source", "n_chars")).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one with the smallest id. Null and empty texts
    are near nothing and stay, and so do rows with a null id. Rows that repeat an id are one document: of those the row
    whose text has the smallest hash stays."""
    found = near_duplicates(docs)
    gone = cut(found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct())
    gone = small(gone)
    left = docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*COLUMNS)
    twice = cut(left.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("_h")).where("_id is not null and n > 1").select("_id", "_h"))
    if twice.isEmpty():
        return left
    marked = left.join(small(twice), left["doc_id"] == F.col("_id"), "left").where(F.col("_id").isNull() | (F.xxhash64("text") == F.col("_h")))
    return marked.where("_id is null").select(*COLUMNS).union(marked.where("_id is not null").dropDuplicates(["doc_id"]).select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. Null sources are a source; null and empty texts have no words
    and come as often as their source's certain copies; of rows that tie at the cut as many are taken as fit."""
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their bins; copies of a document never meet in a bin. Null and empty texts are one
    row without a bin; repeated rows are packed each, and so are rows with a null id."""
    return pack(docs)


STAGES = [("language_id", language_id), ("quality", quality), ("near_dedup", near_dedup), ("source_mix", source_mix), ("packing", packing)]

#: The classifiers and the sketch have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents. Every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
