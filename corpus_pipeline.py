"""Corpus pipeline: stages over documents, each working on all that the one before it kept.

quality classifier -> line dedup -> near-duplicates by SimHash -> benchmark decontamination -> SentencePiece. All but
the last return the columns of documents, whatever they are called. Null texts stay null and count as empty; rows with
null ids and repeated rows go through like others; empty tables stay empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelane.llm import decontaminate, line_dedup, quality, sentencepiece_bpe, simhash
from cuelane.llm.common import remove, shared_folder, table

#: Columns that operators add to the documents they return; own columns of these names are put aside meanwhile.
ADDED = ("expected_grade", "p_top", "keep", "kept_text", "n_lines", "n_dropped")


def _aside(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: f"__own_{c}" for c in docs.columns if c in ADDED})


def _own(name: str, docs: DataFrame) -> str:
    return f"__own_{name}" if name in ADDED and name in docs.columns else name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels of these documents, expects to be good and clean; all where no label is theirs."""
    model = quality.learn(docs, quality.grades_of(table(spark, sf_dir, "labels")))
    return quality.score(_aside(docs), model, extra=True).where("keep").select(*[F.col(_own(c, docs)).alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; n_chars follows the text. A document that loses all lines stays, with the empty text."""
    out = line_dedup.dedup_lines(_aside(docs))

    def column(c: str) -> Column:
        if c == "text":
            return F.when(F.col("text").isNotNull(), F.col("kept_text")).alias(c)
        if c == "n_chars":
            return F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text")).cast(docs.schema[c].dataType).alias(c)
        return F.col(_own(c, docs)).alias(c)

    return out.select(*[column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, as often as it is there; null ids stay."""
    return simhash.drop_similar(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text copies no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts that are left, one row per row."""
    return sentencepiece_bpe.encode_decode(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: Fitting, fingerprints and token merges are beyond SQL; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are written to the shared folder, read again by the next, and removed when that one is written; the last stage's stay."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done is not None:
            remove(spark, done)
        done = f"{folder}/{name}"
    return docs
