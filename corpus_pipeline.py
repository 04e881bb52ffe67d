"""Documents to training tokens: the stages of the corpus pipeline, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import fairmix, icws, langid, linetree, pieces
from ledgerlens.llm.common import read, write_once

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; an ``und`` or doubtful one, or one without evidence, goes."""
    return langid.accepted_documents(docs).select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their lines of recurring templates; a document that loses every line goes.

    A document without a text stays as it is."""
    found = linetree.line_dedup(docs, columns=("lang", "source"))
    emptied = (F.col("n_dropped") > 0) & (F.trim("text") == "")
    return found.filter(~emptied).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near copies; of rows that repeat it one stays."""
    return icws.representatives(docs).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (a copy that it takes in part is kept whole)."""
    return fairmix.mixed_rows(docs).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces, checked by decoding them: ``doc_id, n_ids, ids, exact``."""
    return pieces.checked_ids(docs)


STAGES = [
    ("language", languages),
    ("line_dedup", lines),
    ("near_copies", near_copies),
    ("mix", mix),
    ("sentencepiece", tokens),
]

#: Language scores, near copies and token ids are not stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir))
    return docs
