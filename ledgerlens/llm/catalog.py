"""The registered queries ``opN_<name>``: each operator over its whole table, with SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, divergence, fairmix, icws, langid, licenses, linetree, phrases, pieces, repair, secrets, simhash, toxicity
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_repair(spark, sf_dir):
    return repair.id_digest(read(spark, sf_dir, "documents"))


@query
def op2_simhash(spark, sf_dir):
    return simhash.fingerprint_documents(read(spark, sf_dir, "documents"))


@query
def op3_fair_mix(spark, sf_dir):
    return fairmix.fair_mix(read(spark, sf_dir, "documents"))


@query
def op4_cover_tree(spark, sf_dir):
    return covertree.top_products(read(spark, sf_dir, "embeddings"))


ORACLE["op4_cover_tree"] = covertree.SQL


@query
def op5_language(spark, sf_dir):
    """Documents and web pages, each with its own evidence; the text model is trained on labelled documents."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    model = langid.model_of(docs)
    columns = ["doc_id", "page_id", "declared", "lang", "confidence", "accepted"]
    of_docs = langid.document_languages(docs, model).withColumn("page_id", F.lit(None).cast("long"))
    of_pages = langid.page_languages(pages, model).withColumn("doc_id", F.lit(None).cast("long"))
    return of_docs.select(columns).unionByName(of_pages.select(columns))


@query
def op6_line_dedup(spark, sf_dir):
    return linetree.line_dedup(read(spark, sf_dir, "documents"))


ORACLE["op6_line_dedup"] = linetree.SQL


@query
def op7_near_copies(spark, sf_dir):
    return icws.near_copies(read(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op9_sentencepiece(spark, sf_dir):
    return pieces.token_digest(read(spark, sf_dir, "documents"))


@query
def op10_licenses(spark, sf_dir):
    return licenses.license_spans(read(spark, sf_dir, "documents"))


@query
def op11_divergence(spark, sf_dir):
    return divergence.divergence(read(spark, sf_dir, "documents"))


ORACLE["op11_divergence"] = divergence.SQL


@query
def op12_secrets(spark, sf_dir):
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


ORACLE["op12_secrets"] = secrets.SQL


@query
def op13_phrases(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents"))


ORACLE["op13_phrases"] = phrases.SQL
